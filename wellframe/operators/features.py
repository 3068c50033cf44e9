"""Model features at points along wells, from what lies at or above each point only.

All tables of a well are united and sorted by depth once; every feature is a frame over that one order: last known values,
trailing means and slopes, the station and the top above.  So a well moves once, however many features are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import risk
from wellframe.operators.wells import MIN_COS_INC

#: The trailing window in metres, and the values it needs (fixed values).
WIDTH, LEAST = 30, 3


def thickness(tops: DataFrame, order: DataFrame) -> DataFrame:
    """wellbore_id, formation, gap: positive distances from a top to the next one in stratigraphic order (formation, strat_order)."""
    w = Window.partitionBy("wellbore_id").orderBy("strat_order")
    gaps = tops.join(order, "formation").withColumn("gap", F.lead("top_md_m").over(w) - F.col("top_md_m"))
    return gaps.where("gap > 0").select("wellbore_id", "formation", "gap")


def pool_medians(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Medians over all wells but one, without a join of wells with wells.

    Taking one value out of n sorted ones shifts the middle by one place at most, so the values about the middle of each
    formation and a value's own place are enough.  Gives (wellbore_id, formation, median) of the wells that have a gap, null if
    no other has one, and (formation, median) for all other wells.
    """
    by = Window.partitionBy("formation")
    ranked = gaps.withColumns({"r": F.row_number().over(by.orderBy("gap", "wellbore_id")), "n": F.count("*").over(by)})
    half = F.floor(F.col("n") / 2)
    middle = ranked.where(F.col("r").between(half, half + 2)).groupBy("formation").agg(F.map_from_entries(F.collect_list(F.struct("r", "gap"))).alias("m"), F.first("n").alias("k"))
    at = lambda place: F.try_element_at("m", place.cast("int"))
    low, high = F.floor(F.col("n") / 2), F.floor((F.col("n") + 1) / 2)  # places among the n - 1 others
    shift = lambda k: F.when(k >= F.col("r"), k + 1).otherwise(k)
    own = ranked.join(F.broadcast(middle), "formation").select("wellbore_id", "formation", F.when(F.col("n") > 1, (at(shift(low)) + at(shift(high))) / 2).alias("median"))  # a row for each formation
    every = middle.select("formation", ((at(F.floor((F.col("k") + 1) / 2)) + at(F.floor(F.col("k") / 2) + 1)) / 2).alias("median"))
    return own, every


def base(grid: DataFrame, series: DataFrame, stations: DataFrame, tops: DataFrame, sections: DataFrame, trailing: list[str], latest: list[str]) -> DataFrame:
    """``grid`` (wellbore_id, md_from_m) with tvd_m, hole_size_in, formation, top_md_m, the ``latest`` channels and, of the
    ``trailing`` ones, mean and slope over the last 30 m.

    series: wellbore_id, md_m, channels (flow_ratio comes from flow_in_lpm and flow_out_lpm if it is asked for); stations:
    wellbore_id, md_m, tvd_m, inc_deg; tops: wellbore_id, formation, top_md_m; sections: wellbore_id, md_from_m, md_to_m,
    hole_size_in.  Depths of one well's series are unique.
    """
    if "flow_ratio" in trailing and "flow_ratio" not in series.columns:
        series = series.withColumn("flow_ratio", F.when(F.col("flow_in_lpm") > 0, F.col("flow_out_lpm") / F.nullif("flow_in_lpm", F.lit(0.0))))
    channels = list(dict.fromkeys([*trailing, *latest]))
    kinds = {**{f"c_{c}": "double" for c in channels}, "station": "struct<md:double,tvd:double,inc:double>", "top": "struct<formation:string,md:double>", "section": "struct<till:double,size:double>", "asked": "boolean"}

    def rows(df: DataFrame, md: str, **values: Column) -> DataFrame:
        return df.select("wellbore_id", F.col(md).cast("double").alias("md"), *[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    d = lambda c: F.col(c).cast("double")
    all_ = rows(grid, "md_from_m", asked=F.lit(True))
    all_ = all_.unionByName(rows(series, "md_m", **{f"c_{c}": d(c) for c in channels}))
    all_ = all_.unionByName(rows(stations, "md_m", station=F.struct(d("md_m").alias("md"), d("tvd_m").alias("tvd"), d("inc_deg").alias("inc"))))
    all_ = all_.unionByName(rows(tops, "top_md_m", top=F.struct("formation", d("top_md_m").alias("md"))))
    all_ = all_.unionByName(rows(sections, "md_from_m", section=F.struct(d("md_to_m").alias("till"), d("hole_size_in").alias("size"))))
    all_ = all_.where("md is not null")

    w = Window.partitionBy("wellbore_id").orderBy("md")
    seen, last30, edge = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(-WIDTH, 0), w.rangeBetween(-WIDTH, -WIDTH)
    known = lambda c: F.last(c, ignorenulls=True).over(seen).alias(f"k_{c}")
    inside = lambda e: F.coalesce(F.sum(e).over(last30), F.lit(0.0)) - F.coalesce(F.sum(e).over(edge), F.lit(0.0))
    sums: list[Column] = []
    origin = F.floor(F.col("md") / 1000) * 1000  # keeps squares of depths small
    for c in trailing:
        y = F.col(f"c_{c}")
        # Depths are taken from a mark every kilometre; a window over two kilometres counts from the lower mark of both.
        x = F.when(y.isNotNull(), F.col("md") - origin)
        k = F.when(y.isNotNull(), origin)
        sums += [(F.count(y).over(last30) - F.count(y).over(edge)).alias(f"n_{c}")]
        sums += [inside(e).alias(f"{n}_{c}") for n, e in (("y", y), ("x", x), ("xy", x * y), ("xx", x * x), ("k", k), ("kx", k * x), ("ky", k * y), ("kk", k * k))]
    out = all_.select("wellbore_id", "md", "asked", *[known(n) for n in ("station", "top", "section")], *[known(f"c_{c}") for c in latest], *sums).where("asked")

    s, slope = F.col("k_station"), F.greatest(F.cos(F.radians("k_station.inc")), F.lit(MIN_COS_INC))
    result = [F.col("wellbore_id"), F.col("md").alias("md_from_m"), (s.tvd + (F.col("md") - s.md) * slope).alias("tvd_m"), F.when(F.col("k_section.till") > F.col("md"), F.col("k_section.size")).alias("hole_size_in"), F.col("k_top.formation").alias("formation"), F.col("k_top.md").alias("top_md_m")]
    result += [F.col(f"k_c_{c}").alias(c) for c in latest]
    for c in trailing:
        n, y, x, xy, xx, k, kx, ky, kk = (F.col(f"{p}_{c}") for p in ("n", "y", "x", "xy", "xx", "k", "kx", "ky", "kk"))
        # Sums of x + k - md, from those of x, k and their products.
        m = F.col("md")
        sx, sxy, sxx = x + k - n * m, xy + ky - m * y, xx + kk + n * m * m + 2 * kx - 2 * m * x - 2 * m * k
        det = n * sxx - sx * sx
        result += [F.when(n >= LEAST, y / F.nullif(n, F.lit(0))).alias(f"{c}_mean_30m"), F.when(n >= LEAST, F.when(det > 1e-6, (n * sxy - sx * y) / F.nullif(det, F.lit(0.0)) * WIDTH).otherwise(0.0)).alias(f"{c}_slope_30m")]
    return out.select(*result)


def with_depth_in_formation(rows: DataFrame, tops: DataFrame, order: DataFrame) -> DataFrame:
    """``rows`` with strat_order and relative_depth: the share of the formation's median thickness in the other wells, 0 to 1."""
    own, every = pool_medians(thickness(tops, order))
    medians = rows.join(own.withColumnRenamed("median", "_own").withColumn("_has", F.lit(True)), ["wellbore_id", "formation"], "left").join(F.broadcast(every.withColumnRenamed("median", "_all")), "formation", "left")  # a row for each formation
    median = F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_all"))
    out = medians.join(F.broadcast(order), "formation", "left")
    return out.withColumn("relative_depth", risk.clip01((F.col("md_from_m") - F.col("top_md_m")) / median)).drop("_own", "_has", "_all")
