"""The reports: positions, formations, offsets, predicted tops, look-ahead rates, fused risk, correlation, features.

Inputs are the domain tables: wells (well_id, name, lon, lat, status), wellbores (wellbore_id, well_id, is_primary), stations
(wellbore_id, md_m, tvd_m, north_m, east_m, inc_deg), tops (wellbore_id, formation, source, top_md_m, top_tvdss_m), events (event_id,
wellbore_id, risk_type, formation, md_from_m, md_to_m, review_status, confidence, npt_h).  All run for many wells at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import geo, risk
from wellframe.operators import aggregates, blocks, joins


def wellbore_points(wells: DataFrame, wellbores: DataFrame) -> DataFrame:
    return wellbores.join(wells.select("well_id", "name", "lon", "lat"), "well_id").select("wellbore_id", "name", "lat", "lon")


def positions(probes: DataFrame, stations: DataFrame, points: DataFrame) -> DataFrame:
    """wellbore_id, md_m, lat, lon, tvd_m at each probe (wellbore_id, md_m): clamped to the survey; vertical without one."""
    at = joins.bracket(probes, stations, ["wellbore_id"], "md_m", ["tvd_m", "north_m", "east_m"]).join(points, "wellbore_id")
    moved = geo.offset_position(F.col("lat"), F.col("lon"), F.coalesce("interp_north_m", F.lit(0.0)), F.coalesce("interp_east_m", F.lit(0.0)))
    return at.withColumn("_p", moved).select("wellbore_id", "md_m", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), F.coalesce("interp_tvd_m", "md_m").alias("tvd_m"))


MIN_COS_INC = 0.1


def extended_tvd(probes: DataFrame, stations: DataFrame) -> DataFrame:
    """``probes`` with tvd_m at their md_m; beyond the last station the well goes on at its inclination, without one straight down."""
    last = stations.groupBy("wellbore_id").agg(F.max_by(F.struct("md_m", "tvd_m", "inc_deg"), "md_m").alias("_last"))
    at = joins.bracket(probes, stations, ["wellbore_id"], "md_m", ["tvd_m"]).join(last, "wellbore_id", "left")
    slope = F.greatest(F.cos(F.radians("_last.inc_deg")), F.lit(MIN_COS_INC))
    beyond = F.col("_last.tvd_m") + (F.col("md_m") - F.col("_last.md_m")) * slope
    return at.select(*probes.columns, F.when(F.col("_last").isNull(), F.col("md_m")).when(F.col("md_m") > F.col("_last.md_m"), beyond).otherwise(F.col("interp_tvd_m")).alias("tvd_m"))


def extended_md(probes: DataFrame, stations: DataFrame) -> DataFrame:
    """``probes`` with the md_m where the well first reaches their tvd_m, extended beyond both ends at their inclinations."""
    w = Window.partitionBy("wellbore_id").orderBy("md_m")
    legs = stations.select("wellbore_id", F.col("tvd_m").alias("_t0"), F.col("md_m").alias("_m0"), F.lead("tvd_m").over(w).alias("_t1"), F.lead("md_m").over(w).alias("_m1")).where("_t1 is not null")
    legs = legs.withColumn("r_from", F.least("_t0", "_t1")).withColumn("r_to", F.greatest("_t0", "_t1") + 1e-9)
    ask = probes.select("wellbore_id", F.col("tvd_m").alias("l_from")).distinct().withColumn("l_to", F.col("l_from") + 1e-9)
    part = F.when(F.col("_t1") == F.col("_t0"), 0.0).otherwise((F.col("l_from") - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    on = joins.overlap(ask, legs, ["wellbore_id"], 250.0).where("r_from <= l_from and l_from <= greatest(_t0, _t1)")
    on = on.groupBy("wellbore_id", F.col("l_from").alias("tvd_m")).agg(F.min_by(F.col("_m0") + part * (F.col("_m1") - F.col("_m0")), "_m0").alias("_md"))
    ends = stations.groupBy("wellbore_id").agg(F.min_by(F.struct("md_m", "tvd_m", "inc_deg"), "md_m").alias("_a"), F.max_by(F.struct("md_m", "tvd_m", "inc_deg"), "md_m").alias("_z"))
    slope = lambda e: F.greatest(F.cos(F.radians(f"{e}.inc_deg")), F.lit(MIN_COS_INC))
    above = F.greatest(F.lit(0.0), F.col("_a.md_m") - (F.col("_a.tvd_m") - F.col("tvd_m")) / slope("_a"))
    below = F.col("_z.md_m") + (F.col("tvd_m") - F.col("_z.tvd_m")) / slope("_z")
    out = probes.join(ends, "wellbore_id", "left").join(on, ["wellbore_id", "tvd_m"], "left")
    md = F.when(F.col("_z").isNull(), F.col("tvd_m")).when(F.col("tvd_m") < F.col("_a.tvd_m"), above).when(F.col("_md").isNotNull(), F.col("_md")).when(F.col("tvd_m") == F.col("_a.tvd_m"), F.col("_a.md_m")).otherwise(below)
    return out.select(*probes.columns, md.alias("md_m"))


def best_tops(tops: DataFrame) -> DataFrame:
    """One top of each formation: the best source before any depth is looked at."""
    rank = risk.lookup(F.col("source"), risk.TOP_SOURCE_RANK, 9)
    return aggregates.distinct_on(tops.where("top_md_m is not null"), ["wellbore_id", "formation"], [rank, F.col("top_md_m")])


def formations(probes: DataFrame, tops: DataFrame) -> DataFrame:
    """The formation at each probe, its top, the next top and the relative depth (null without a next one)."""
    best = best_tops(tops)
    w = Window.partitionBy("wellbore_id").orderBy("top_md_m", "formation")
    best = best.withColumn("next_top_md_m", F.lead("top_md_m").over(w)).withColumn("top", F.col("top_md_m"))
    at = joins.asof(probes, best.withColumnRenamed("top_md_m", "md_m"), ["wellbore_id"], "md_m", ["formation", "top", "next_top_md_m"])
    rel = risk.clip01((F.col("md_m") - F.col("asof_top")) / F.nullif(F.col("asof_next_top_md_m") - F.col("asof_top"), F.lit(0.0)))
    return at.select(*probes.columns, F.col("asof_formation").alias("formation"), F.col("asof_top").alias("top_md_m"), F.col("asof_next_top_md_m").alias("next_top_md_m"), rel.alias("relative_depth"))


def offsets_within(wells: DataFrame, wellbores: DataFrame, stations: DataFrame, probes: DataFrame, events: DataFrame, radius_m: float, mode: str = "surface", depth: bool = True, ordered: bool = True) -> DataFrame:
    """wellbore_id, other_id, surface_m, depth_m, n_events: neighbours of each probed wellbore; if ``ordered``, nearest first by mode.

    Depth mode measures in space at the probe's vertical depth, falls back to the surface distance, and still looks no
    further than 5 km beyond the radius on the surface.  Without ``depth``, in surface mode, depth_m is null and no survey is read.
    """
    pts = wellbore_points(wells, wellbores)
    ids = pts.select(F.col("wellbore_id").alias("id"), "lat", "lon")
    n = events.where("review_status <> 'rejected'").groupBy(F.col("wellbore_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"))
    # There are far more pairs than wells: all that a pair needs is with its wells before they meet, and no pair moves.
    others = ids.join(n, "id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    names = {"id": "wellbore_id", "distance_m": "surface_m"}
    if mode != "depth" and not depth:
        asked = ids.join(probes.select(F.col("wellbore_id").alias("id")), "id")
        out = joins.radius(asked, others, radius_m, geo.geodesic_m, with_right=("n_events",)).withColumnsRenamed(names)
        out = out.select("wellbore_id", "other_id", "surface_m", F.lit(None).cast("double").alias("depth_m"), "n_events")
        return out.orderBy("wellbore_id", "surface_m", "other_id") if ordered else out
    here = positions(probes, stations, pts).select(F.col("wellbore_id").alias("id"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.col("tvd_m").alias("tvd0"))
    reach = here.agg(F.min("tvd0").alias("_least"), F.max("tvd0").alias("_most"))
    asked = ids.join(here, "id").crossJoin(F.broadcast(reach)).withColumn("_t", F.coalesce("tvd0", "_least"))
    legs = survey_legs(stations, pts).crossJoin(F.broadcast(reach)).where("_from <= _most and _till > _least").drop("_least", "_most")
    others = others.join(legs.withColumnRenamed("wellbore_id", "id"), "id", "left")
    # No survey: straight down.
    place = lambda p: {f"{p}_{c}": F.col(f"_{p}.{c}") for c in ("md", "lat", "lon", "tvd")}
    vertical = F.struct(F.lit(None).cast("double").alias("md"), "lat", "lon", F.lit(None).cast("double").alias("tvd"))
    others = others.withColumns({"_c": F.when(F.col("_from").isNull(), vertical).otherwise(F.col("_c")), "_from": F.coalesce("_from", F.lit(float("-inf"))), "_till": F.coalesce("_till", F.lit(float("inf")))})
    others = others.withColumns({"has_b": F.col("_b").isNotNull(), "has_c": F.col("_c").isNotNull(), **place("a"), **place("b"), **place("c")}).withColumnsRenamed({"_from": "from", "_till": "till"})
    asked = asked.select("id", "lat", "lon", "lat0", "lon0", "tvd0", F.col("_t").alias("t"))
    others = others.select("id", "lat", "lon", "n_events", "from", "till", "has_b", "has_c", *[f"{p}_{c}" for p in "abc" for c in ("md", "lat", "lon", "tvd")])
    kind = ids.schema["id"].dataType.simpleString()
    reach_m = radius_m + (5000.0 if mode == "depth" else 0.0)
    out = blocks.near(asked, others, [], reach_m, _in_space(reach_m, radius_m, mode), f"wellbore_id {kind}, other_id {kind}, surface_m double, depth_m double, n_events bigint")
    return out.orderBy("wellbore_id", F.coalesce("depth_m", "surface_m") if mode == "depth" else F.col("surface_m"), "other_id") if ordered else out


def _in_space(reach_m: float, radius_m: float, mode: str):
    """A function for the pairs of a block: those whose neighbour is at the leg asked for, with both distances, within the radius by ``mode``."""

    def block(held: blocks.Held, rights: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat0, lon0, tvd0, t = (blocks.numbers(held.rows, f"l_{c}") for c in ("lat0", "lon0", "tvd0", "t"))
        for right in rights:
            for some, j, i, surface in held.near(right, reach_m):
                get = lambda c: blocks.numbers(some, f"r_{c}")  # noqa: B023, E731
                lo, hi = get("from")[j], get("till")[j]
                at = np.isnan(t[i]) | (t[i] >= lo) & (t[i] < hi)
                j, i, surface, lo, hi = j[at], i[at], surface[at], lo[at], hi[at]
                # The neighbour's station nearest to the probe's vertical depth gives the measured depth to compare at.
                z, has_b, has_c = tvd0[i], get("has_b")[j] > 0, get("has_c")[j] > 0
                down, up = np.abs(lo - z), np.abs(hi - z)
                b = ~has_c | (down < up) | (down == up) & (get("b_md")[j] <= get("c_md")[j])
                which = np.where(~has_b, 2, np.where(z == lo, 0, np.where(b, 1, 2)))
                lat, lon, tvd = (np.stack([get(f"{p}_{c}") for p in "abc"])[which, j] for c in ("lat", "lon", "tvd"))
                tvd = np.where(np.isnan(tvd), z, tvd)
                depth = np.hypot(geo.spheroid_m(lat0[i], lon0[i], lat, lon), z - tvd)
                used = np.where(np.isnan(depth), surface, depth) if mode == "depth" else surface
                keep = used <= radius_m
                j, i = pa.array(j[keep]), pa.array(i[keep])
                columns = [held.rows.column("l_id").take(i), some.column("r_id").take(j), pa.array(surface[keep]), pa.array(depth[keep], from_pandas=True), some.column("r_n_events").take(j)]
                yield pa.record_batch(columns, ["wellbore_id", "other_id", "surface_m", "depth_m", "n_events"])

    return block


def survey_legs(stations: DataFrame, points: DataFrame) -> DataFrame:
    """Vertical depths [_from, _till) of each surveyed wellbore, with the places (md, lat, lon, tvd) of the stations at both ends.

    _a and _b are the shallowest and deepest station by measured depth at _from, _c the shallowest at _till; the legs reach to infinity.
    """
    s = stations.where("tvd_m is not null and md_m is not null")
    at = positions(s.select("wellbore_id", "md_m").distinct(), stations, points).select("wellbore_id", "md_m", F.struct(F.col("md_m").alias("md"), "lat", "lon", F.col("tvd_m").alias("tvd")).alias("_p"))
    ends = s.select("wellbore_id", "tvd_m", "md_m").join(at, ["wellbore_id", "md_m"]).groupBy("wellbore_id", F.col("tvd_m").alias("_from")).agg(F.min_by("_p", "md_m").alias("_a"), F.max_by("_p", "md_m").alias("_b"))
    w = Window.partitionBy("wellbore_id").orderBy("_from")
    ends = ends.withColumns({"_till": F.coalesce(F.lead("_from").over(w), F.lit(float("inf"))), "_c": F.lead("_a").over(w), "_k": F.row_number().over(w)})
    none = F.lit(None).cast(ends.schema["_a"].dataType)
    head = ends.where("_k = 1").select("wellbore_id", F.lit(float("-inf")).alias("_from"), none.alias("_a"), none.alias("_b"), F.col("_from").alias("_till"), F.col("_a").alias("_c"))
    return ends.drop("_k").unionByName(head)


def nearest_offsets(wells: DataFrame, wellbores: DataFrame, probes: DataFrame, radius_m: float, need: float, weights: DataFrame | None = None) -> DataFrame:
    """wellbore_id, other_id, surface_m: of each probed wellbore's neighbours the nearest, as many as weigh ``need`` together.

    weights: wellbore_id, weight; neighbours without one are left out.  Without weights each weighs 1.
    """
    ids = wellbore_points(wells, wellbores).select(F.col("wellbore_id").alias("id"), "lat", "lon")
    asked = ids.join(probes.select(F.col("wellbore_id").alias("id")).distinct(), "id")
    others = ids.join(weights.withColumnRenamed("wellbore_id", "id"), "id") if weights is not None else ids.withColumn("weight", F.lit(1))
    return joins.nearest_within(asked, others, radius_m, need, geo.geodesic_m).withColumnsRenamed({"id": "wellbore_id", "distance_m": "surface_m"})


def events_for_offsets(offsets: DataFrame, events: DataFrame, formations_: list[str] | None = None, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Events of the neighbours, ``limit`` of each probed well, nearest well first, then by depth; rejected ones never.  In that order only if ``ordered``."""
    e = events.where("review_status <> 'rejected'")
    e = e.where(F.col("formation").isin(formations_)) if formations_ else e
    order = ["surface_m", "other_id", "md_from_m", "event_id"]
    if limit:  # no more of a neighbour's events can be among the first of any well
        own = Window.partitionBy("wellbore_id").orderBy("md_from_m", "event_id")
        e = e.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= limit).drop("_n")
    out = offsets.join(e.withColumnRenamed("wellbore_id", "other_id"), "other_id")
    if limit:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("wellbore_id").orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
    return out.orderBy("wellbore_id", *order) if ordered else out


def predict_tops(offsets: DataFrame, tops: DataFrame, order: DataFrame, nearest: int = 12, gap: float = 5.0) -> DataFrame:
    """Predicted tops with uncertainty, by the nearest neighbours' actual tops, repaired to stratigraphic order.

    order: formation, strat_order.  Formations that fewer than two neighbours have are left out.
    """
    w = Window.partitionBy("wellbore_id").orderBy("surface_m", "other_id")
    near = offsets.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= nearest)
    actual = tops.where("source = 'actual' and top_md_m is not null").select(F.col("wellbore_id").alias("other_id"), "formation", "top_md_m")
    p = aggregates.weighted_prediction(near.join(actual, "other_id"), ["wellbore_id", "formation"], "top_md_m", "surface_m").join(order, "formation")
    from wellframe.operators.windows import repaired

    out = repaired(p, ["wellbore_id"], ["strat_order", "formation"], "predicted", gap)
    return out.select("wellbore_id", "formation", "strat_order", F.col("fixed").alias("top_md_m"), (F.col("uncertainty") + F.col("raised")).alias("uncertainty_m"), "n")


def hit(interval_rel: Column, event_rel: Column, mid: Column, top_active: Column, top_offset: Column, event_md: Column) -> Column:
    """The same relative depth within a tenth; where one is unknown, the same equivalent depth within 25 m."""
    rel = F.abs(event_rel - interval_rel) <= risk.L1_REL_TOL + risk.EPS
    md = F.coalesce(F.abs(event_md - (top_offset + mid - top_active)) <= risk.L1_MD_TOL_M + risk.EPS, F.lit(False))
    return F.when(interval_rel.isNotNull() & event_rel.isNotNull(), rel).otherwise(md)


def l1_scores(intervals: DataFrame, offsets: DataFrame, events: DataFrame) -> DataFrame:
    """The smoothed weighted hit rate of each interval and risk, with its counts and five heaviest reasons.

    intervals: interval_id, formation, relative_depth, md_mid_m, top_md_m.  offsets: interval_id, wellbore_id, depth_distance_m, drilled,
    top_md_m.  events: wellbore_id, event_id, risk_type, formation, relative_depth, md_from_m, review_status, confidence.
    """
    used = offsets.where("drilled and depth_distance_m is not null").withColumn("w", F.exp(-F.col("depth_distance_m") / risk.L1_DECAY_M)).withColumnRenamed("top_md_m", "offset_top")
    total = used.groupBy("interval_id").agg(F.sum("w").alias("sw"), F.count(F.lit(1)).alias("n_offsets"))
    e = events.where("review_status <> 'rejected'").select("wellbore_id", "event_id", "risk_type", "formation", F.col("relative_depth").alias("event_rel"), "md_from_m", "review_status", "confidence")
    h = used.join(intervals, "interval_id").join(e, ["wellbore_id", "formation"]).where(hit(F.col("relative_depth"), F.col("event_rel"), F.col("md_mid_m"), F.col("top_md_m"), F.col("offset_top"), F.col("md_from_m")))
    h = h.withColumn("ew", F.when(F.col("review_status") == "pending", risk.PENDING_WEIGHT).otherwise(1.0))
    best = h.groupBy("interval_id", "risk_type", "wellbore_id").agg(F.max(F.col("w") * F.col("ew")).alias("top"), F.sum("confidence").alias("sc"), F.count("confidence").alias("nc"), F.count_if(F.col("review_status") == "pending").alias("np"))
    rates = best.groupBy("interval_id", "risk_type").agg(F.sum("top").alias("swh"), (F.sum("sc") / F.nullif(F.sum("nc"), F.lit(0))).alias("mean_conf"), F.sum("np").alias("n_unreviewed"))
    order = Window.partitionBy("interval_id", "risk_type").orderBy(F.desc(F.col("w") * F.col("ew")), "event_id")
    why = h.withColumn("_k", F.row_number().over(order)).where("_k <= 5").groupBy("interval_id", "risk_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "event_id"))), lambda x: x.event_id).alias("reasons"))
    risks = sorted(set(risk.RISK_OF_EVENT.values()))
    grid = intervals.select("interval_id").join(total, "interval_id", "left").withColumn("risk_type", F.explode(F.array(*map(F.lit, risks))))
    out = grid.join(rates, ["interval_id", "risk_type"], "left").join(why, ["interval_id", "risk_type"], "left")
    l1 = F.when(F.coalesce("sw", F.lit(0.0)) > 0, (F.coalesce("swh", F.lit(0.0)) + risk.L1_PRIOR_HIT) / (F.col("sw") + risk.L1_PRIOR_WEIGHT))
    return out.select("interval_id", "risk_type", l1.alias("l1"), F.coalesce("n_offsets", F.lit(0)).alias("n_offsets"), "mean_conf", F.coalesce("n_unreviewed", F.lit(0)).alias("n_unreviewed"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def lookahead(bits: DataFrame, cells: int = 12) -> DataFrame:
    """The cells ahead of each bit, anchored to multiples of 25 m."""
    start = F.floor(F.col("bit_md_m") / risk.INTERVAL_M) * risk.INTERVAL_M
    g = bits.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("md_from_m", start + risk.INTERVAL_M * F.col("k"))
    return g.withColumn("md_to_m", F.col("md_from_m") + risk.INTERVAL_M).withColumn("md_mid_m", F.col("md_from_m") + risk.INTERVAL_M / 2)


def fused_scores(layers: DataFrame) -> DataFrame:
    """Rows (…, md_from_m, md_to_m, bit_md_m, l1, l2, l3, floor): detectors count in the bit's own cell only; no layer, no row."""
    here = (F.col("md_from_m") <= F.col("bit_md_m")) & (F.col("bit_md_m") < F.col("md_to_m"))
    out = layers.withColumn("fused", risk.fuse([F.col("l1"), F.col("l2"), F.when(here, F.col("l3"))], F.when(here, F.col("floor"))))
    return out.where("fused is not null").withColumn("band", risk.band(F.col("fused")))


def correlation_tracks(series: DataFrame, bits: DataFrame, flatten_on: DataFrame, channels: list[str], limit: int = 2000) -> DataFrame:
    """Visible, downsampled tracks, shifted so that a chosen top lies at zero."""
    from wellframe.operators.windows import downsampled

    seen = series.join(bits, "wellbore_id", "left").where("bit_md_m is null or md_m <= bit_md_m").select("wellbore_id", "md_m", *channels)
    return downsampled(seen, ["wellbore_id"], ["md_m"], "torque_knm", limit).join(flatten_on, "wellbore_id", "left").withColumn("shifted_m", F.col("md_m") - F.coalesce("top_md_m", F.lit(0.0)))


def labels_ahead(grid: DataFrame, events: DataFrame, near: float = 50.0, far: float = 300.0) -> DataFrame:
    """Whether an event of each risk begins 50 to 300 m ahead of a cell, both ends included."""
    e = events.where("review_status <> 'rejected' and risk_type is not null").select("wellbore_id", "risk_type", F.col("md_from_m").alias("r_from"), (F.col("md_from_m") + 1e-6).alias("r_to"))
    g = grid.withColumn("l_from", F.col("md_from_m") + near).withColumn("l_to", F.col("md_from_m") + far + 1e-9)
    return joins.overlap(g, e, ["wellbore_id"], 250.0).where((F.col("r_from") >= F.col("l_from")) & (F.col("r_from") <= F.col("md_from_m") + far)).select("wellbore_id", "md_from_m", "risk_type").distinct()


def well_summary(wells: DataFrame, wellbores: DataFrame, events: DataFrame) -> DataFrame:
    """Every well with its events, hours lost and most frequent risk; rejected events don't count, those without a risk do."""
    e = events.where("review_status <> 'rejected'").join(wellbores.select("wellbore_id", "well_id"), "wellbore_id")
    n = e.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("npt_h").alias("npt"))
    top = aggregates.mode_first(e, ["well_id"], "risk_type", "top_risk")
    return wells.join(n, "well_id", "left").join(top, "well_id", "left").select("well_id", "name", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("npt", F.lit(0.0)).alias("npt_h"), "top_risk")


def npt_by_formation(wellbores: DataFrame, events: DataFrame) -> DataFrame:
    e = events.where("review_status <> 'rejected' and risk_type is not null").join(wellbores.select("wellbore_id", "well_id"), "wellbore_id")
    return e.groupBy("formation", "risk_type").agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("npt_h"), F.lit(0.0)).alias("npt_h"), F.countDistinct("well_id").alias("n_wells"))
