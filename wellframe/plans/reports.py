"""The well reports on a field derived from the driver's tables: suppliers are wells, their lines are hazard events.

The SQL of positions and of the offset reports unrolls the spheroid's iteration into a chain of subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.functions import geo, risk
from wellframe.operators import lookahead, views, wells
from wellframe.plans.registry import Tables, query

FORMATIONS = ["Alpha", "Beta", "Gamma", "Delta"]


def field(t: Tables) -> dict[str, DataFrame]:
    k = F.col("s_suppkey")
    s = t.supplier.select(k.cast("string").alias("wellbore_id"), k.alias("k"), "s_name")
    tops = s.select("wellbore_id", F.posexplode(F.array(*map(F.lit, FORMATIONS))).alias("i", "formation"), "k")
    q = F.col("l_quantity")
    return {
        "wells": s.select(F.col("wellbore_id").alias("well_id"), F.col("s_name").alias("name"), (90 + (F.col("k") * 101 % 991) / 100.0).alias("lon"), (20 + (F.col("k") * 37 % 997) / 100.0).alias("lat")),
        "wellbores": s.select("wellbore_id", F.col("wellbore_id").alias("well_id"), F.lit(True).alias("is_primary")),
        "stations": s.where("k % 3 <> 0").select("wellbore_id", "k", F.explode(F.array(F.lit(0.0), F.lit(1000.0), F.lit(2500.0))).alias("md_m")).select("wellbore_id", "md_m", (F.col("md_m") * 0.97).alias("tvd_m"), F.lit(0.0).alias("north_m"), (F.col("md_m") * (F.col("k") % 5) / 20).alias("east_m"), F.lit(5.0).alias("inc_deg")),
        "tops": tops.select("wellbore_id", "formation", F.lit("actual").alias("source"), (600.0 * (F.col("i") + 1) + F.col("k") * 37 % 101).alias("top_md_m")),
        "order": t.spark.createDataFrame([(f, i) for i, f in enumerate(FORMATIONS)], "formation string, strat_order int"),
        "events": t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.col("l_suppkey").cast("string").alias("wellbore_id"), risk.lookup(F.col("l_returnflag"), {"R": "losses", "A": "kick"}).alias("risk_type"), (q * 50).alias("md_from_m"), (q * 50 + 20).alias("md_to_m"), F.when(F.col("l_tax") > 0.07, "rejected").when(F.col("l_tax") > 0.05, "pending").otherwise("approved").alias("review_status"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_discount").alias("npt_h")),
    }


def _probes(f: dict[str, DataFrame]) -> DataFrame:
    return f["wellbores"].select("wellbore_id", F.lit(1200.0).alias("md_m"))


#: Half of the supplier table's wells at 1,200 m: 240 m east at most, by four steps of the direct problem due east.
_DIRECT = f"""
    w AS (SELECT s_suppkey AS k, (90 + (s_suppkey * 101 % 991) / 100.0)::DOUBLE AS lon, (20 + (s_suppkey * 37 % 997) / 100.0)::DOUBLE AS lat, CASE WHEN s_suppkey % 3 <> 0 THEN 1200.0 * (s_suppkey % 5) / 20 ELSE 0 END::DOUBLE AS s FROM supplier),
    a AS (SELECT *, atan((1 - {geo.FLATTENING}::DOUBLE) * tan(radians(lat))) AS u, cos(u) AS sa, 1 - sa * sa AS q, q * {(geo.A**2 - geo.B**2) / geo.B**2}::DOUBLE AS e,
          1 + e / 16384 * (4096 + e * (-768 + e * (320 - 175 * e))) AS ga, e / 1024 * (256 + e * (-128 + e * (74 - 47 * e))) AS gb, s / ({geo.B}::DOUBLE * ga) AS x0, pi() AS m0 FROM w),
    b AS (SELECT *, {{steps}} FROM a),
    c AS (SELECT *, {geo.FLATTENING}::DOUBLE / 16 * q * (4 + {geo.FLATTENING}::DOUBLE * (4 - 3 * q)) AS g, atan2(sin(x4), cos(u) * cos(x4)) AS l FROM b)"""
_STEPS = ", ".join(f"cos(m0 + x{i}) AS c{i}, x0 + gb * sin(x{i}) * (c{i} + gb / 4 * (cos(x{i}) * (2 * c{i} * c{i} - 1) - gb / 6 * c{i} * (4 * sin(x{i}) ^ 2 - 3) * (4 * c{i} * c{i} - 3))) AS x{i + 1}" for i in range(4))


@query("cq01_positions", f"""
    WITH {_DIRECT.format(steps=_STEPS)}
    SELECT k::VARCHAR AS wellbore_id, 1200.0::DOUBLE AS md_m, round(degrees(atan2(sin(u) * cos(x4), (1 - {geo.FLATTENING}::DOUBLE) * sqrt(sa * sa + (sin(u) * sin(x4)) ^ 2))), 7) AS lat,
           round(lon + degrees(l - (1 - g) * {geo.FLATTENING}::DOUBLE * sa * (x4 + g * sin(x4) * (cos(m0 + x4) + g * cos(x4) * (2 * cos(m0 + x4) ^ 2 - 1)))), 7) AS lon, CASE WHEN k % 3 = 0 THEN 1200 ELSE 1164 END::DOUBLE AS tvd_m FROM c""")
def positions(t: Tables) -> DataFrame:
    f = field(t)
    out = wells.positions(_probes(f), f["stations"], wells.wellbore_points(f["wells"], f["wellbores"]))
    return out.select("wellbore_id", "md_m", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("tvd_m", 6).alias("tvd_m"))


@query("cq02_formations", """
    WITH x AS (SELECT s_suppkey AS k, s_suppkey * 37 % 101 AS c, floor((1200 - c) / 600)::INT AS i FROM supplier)
    SELECT k::VARCHAR AS wellbore_id, 1200.0::DOUBLE AS md_m, ['Alpha', 'Beta', 'Gamma', 'Delta'][i] AS formation, (600 * i + c)::DOUBLE AS top_md_m, (600 * (i + 1) + c)::DOUBLE AS next_top_md_m, round((1200 - 600 * i - c) / 600.0, 6)::DOUBLE AS relative_depth FROM x""")
def formations(t: Tables) -> DataFrame:
    f = field(t)
    return wells.formations(_probes(f), f["tops"]).withColumn("relative_depth", F.round("relative_depth", 6))


_KEPT = "SELECT l_suppkey AS k, CASE l_returnflag WHEN 'R' THEN 'losses' WHEN 'A' THEN 'kick' END AS r, l_discount AS npt FROM lineitem WHERE l_tax <= 0.07"


@query("cq06_well_summary", f"""
    WITH e AS ({_KEPT}), n AS (SELECT k, count(*) AS n, sum(npt) AS npt FROM e GROUP BY 1), m AS (SELECT k, r FROM (SELECT k, r, count(*) AS c FROM e WHERE r IS NOT NULL GROUP BY k, r) QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, r) = 1)
    SELECT s_suppkey::VARCHAR AS well_id, s_name AS name, coalesce(n, 0)::BIGINT AS n_events, round(coalesce(npt, 0), 6)::DOUBLE AS npt_h, m.r AS top_risk FROM supplier LEFT JOIN n ON n.k = s_suppkey LEFT JOIN m ON m.k = s_suppkey""")
def well_summary(t: Tables) -> DataFrame:
    f = field(t)
    return wells.well_summary(f["wells"], f["wellbores"], f["events"]).withColumn("npt_h", F.round("npt_h", 6))


@query("cq06_view_wellbores", f"""
    WITH e AS ({_KEPT}), n AS (SELECT k, count(*) AS n, sum(npt) AS npt FROM e GROUP BY 1), m AS (SELECT k, r FROM (SELECT k, r, count(*) AS c FROM e WHERE r IS NOT NULL GROUP BY k, r) QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, r) = 1)
    SELECT s_suppkey::VARCHAR AS wellbore_id, s_name AS name, coalesce(n, 0)::BIGINT AS event_count, round(coalesce(npt, 0), 6)::DOUBLE AS npt_h_total, m.r AS top_risk_type FROM supplier LEFT JOIN n ON n.k = s_suppkey LEFT JOIN m ON m.k = s_suppkey""")
def view_wellbores(t: Tables) -> DataFrame:
    f = field(t)
    return views.well_summary(f["wellbores"], f["wells"], f["events"]).select("wellbore_id", "name", "event_count", F.round("npt_h_total", 6).alias("npt_h_total"), "top_risk_type")


@query("cq06_view_npt", """
    SELECT CASE WHEN l_quantity < 15 THEN 'Alpha' WHEN l_quantity < 30 THEN 'Beta' END AS formation, CASE l_returnflag WHEN 'R' THEN 'losses' WHEN 'A' THEN 'kick' END AS risk_type, count(*) AS event_count, round(sum(l_discount), 4)::DOUBLE AS npt_h_total, count(DISTINCT l_suppkey) AS well_count
    FROM lineitem WHERE l_tax <= 0.07 AND l_returnflag IN ('R', 'A') GROUP BY 1, 2""")
def view_npt(t: Tables) -> DataFrame:
    f = field(t)
    md = F.col("md_from_m")
    e = f["events"].withColumn("formation", F.when(md < 750, "Alpha").when(md < 1500, "Beta"))
    return views.npt_by_formation(e, f["wellbores"]).withColumn("npt_h_total", F.round("npt_h_total", 4))


@query("cq06_view_alerts", """
    SELECT o_orderkey AS alert_id, o_custkey::VARCHAR AS wellbore_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'generated' WHEN '2-HIGH' THEN 'escalated' WHEN '3-MEDIUM' THEN 'viewed' END AS state, c_name AS well_name
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def view_alerts(t: Tables) -> DataFrame:
    """Customers are wells, orders their alerts; the two lower priorities are resolved and rated ones."""
    state = risk.lookup(F.col("o_orderpriority"), {"1-URGENT": "generated", "2-HIGH": "escalated", "3-MEDIUM": "viewed", "4-NOT SPECIFIED": "resolved"}, "feedback")
    alerts = t.orders.select(F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").cast("string").alias("wellbore_id"), state.alias("state"))
    c = t.customer.select(F.col("c_custkey").cast("string").alias("well_id"), F.col("c_name").alias("name"))
    return views.open_alerts(alerts, c.select(F.col("well_id").alias("wellbore_id"), "well_id"), c)


@query("cq06_view_queue", """
    SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS field_id, 'pending' AS review_status, o_orderpriority AS doc_title, o_orderstatus AS doc_type, CASE WHEN n.image THEN l_orderkey || '/' || l_linenumber END AS image_path
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber AS p, true AS image FROM lineitem WHERE l_linestatus = 'F') n ON n.k = l_orderkey AND n.p = l_linenumber WHERE l_returnflag = 'N'""")
def view_queue(t: Tables) -> DataFrame:
    """Lines are fields of their orders, pending if nothing came back; pages of finished lines have images."""
    key = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber")]
    fields = t.lineitem.select(key[0], key[1].alias("page"), F.col("l_partkey").alias("field_id"), F.when(F.col("l_returnflag") == "N", "pending").otherwise("approved").alias("review_status"))
    pages = t.lineitem.where("l_linestatus = 'F'").select(key[0], key[1].alias("page_no")).distinct().withColumn("image_path", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_no").cast("string")))
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("doc_type"))
    return views.review_queue(fields, docs, pages)


@query("cq06_view_trajectories", """
    WITH p AS (SELECT s_suppkey AS k, s_name, m, round((90 + (s_suppkey * 101 % 991) / 100.0)::DOUBLE + m * (s_suppkey % 5) / 2000000, 6)::DOUBLE AS lon, (20 + (s_suppkey * 37 % 997) / 100.0)::DOUBLE AS lat FROM supplier, (VALUES (0), (1000), (2500)) v(m) WHERE s_suppkey % 3 <> 0)
    SELECT k::VARCHAR AS wellbore_id, any_value(s_name) AS well_name, '{"type":"LineString","coordinates":[' || string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY m) || ']}' AS geojson FROM p GROUP BY k""")
def view_trajectories(t: Tables) -> DataFrame:
    f = field(t)
    at = f["stations"].join(f["wellbores"], "wellbore_id").join(f["wells"], "well_id")
    stations = at.select("wellbore_id", "md_m", F.round(F.col("lon").cast("double") + F.col("east_m") / 100_000, 6).alias("lon"), F.col("lat").cast("double").alias("lat"))
    return views.trajectory_geojson(stations, f["wellbores"], f["wells"])


@query("fn07_extended_tvd", """
    WITH p AS (SELECT s_suppkey AS k, 100.0 * g AS md FROM supplier, range(0, 41, 4) r(g))
    SELECT k::VARCHAR AS wellbore_id, md::DOUBLE AS md_m, round(CASE WHEN k % 3 = 0 THEN md WHEN md <= 2500 THEN 0.97 * md ELSE 2425 + (md - 2500) * cos(radians(5)) END, 4)::DOUBLE AS tvd_m FROM p""")
def extended_tvd(t: Tables) -> DataFrame:
    f = field(t)
    probes = f["wellbores"].select("wellbore_id", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(4))).alias("g")).select("wellbore_id", (F.col("g") * 100.0).alias("md_m"))
    return wells.extended_tvd(probes, f["stations"]).withColumn("tvd_m", F.round("tvd_m", 4))


@query("fn07_extended_md", """
    WITH p AS (SELECT s_suppkey AS k, 100.0 * g AS tvd FROM supplier, range(0, 41, 4) r(g))
    SELECT k::VARCHAR AS wellbore_id, tvd::DOUBLE AS tvd_m, round(CASE WHEN k % 3 = 0 THEN tvd WHEN tvd <= 2425 THEN tvd / 0.97 ELSE 2500 + (tvd - 2425) / cos(radians(5)) END, 4)::DOUBLE AS md_m FROM p""")
def extended_md(t: Tables) -> DataFrame:
    f = field(t)
    probes = f["wellbores"].select("wellbore_id", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(4))).alias("g")).select("wellbore_id", (F.col("g") * 100.0).alias("tvd_m"))
    return wells.extended_md(probes, f["stations"]).withColumn("md_m", F.round("md_m", 4))


def _pairs_sql(radius_m: float) -> str:
    """SQL subqueries that end in ``near`` (k, o, d): other wells on the spheroid within a radius, by eight steps of the inverse problem."""
    f, e2 = geo.FLATTENING, (geo.A**2 - geo.B**2) / geo.B**2
    at = """sqrt((cos(u2) * sin({x})) ^ 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos({x})) ^ 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos({x}) AS cs,
        coalesce(cos(u1) * cos(u2) * sin({x}) / nullif(ss, 0), 0) AS sa, 1 - sa * sa AS q, coalesce(cs - 2 * sin(u1) * sin(u2) / nullif(q, 0), 0) AS m"""
    steps = ["w AS (SELECT s_suppkey AS k, (90 + (s_suppkey * 101 % 991) / 100.0)::DOUBLE AS lon, (20 + (s_suppkey * 37 % 997) / 100.0)::DOUBLE AS lat FROM supplier)"]
    steps.append(f"g0 AS (SELECT a.k, b.k AS o, atan((1 - {f}::DOUBLE) * tan(radians(a.lat))) AS u1, atan((1 - {f}::DOUBLE) * tan(radians(b.lat))) AS u2, radians(b.lon - a.lon) AS l, l AS x0 FROM w a JOIN w b ON a.k <> b.k AND abs(a.lat - b.lat) < {radius_m / 100_000})")
    for i in range(8):
        steps.append(f"g{i + 1} AS (SELECT k, o, u1, u2, l, {at.format(x=f'x{i}')}, {f}::DOUBLE / 16 * q * (4 + {f}::DOUBLE * (4 - 3 * q)) AS g, l + (1 - g) * {f}::DOUBLE * sa * (atan2(ss, cs) + g * ss * (m + g * cs * (2 * m * m - 1))) AS x{i + 1} FROM g{i})")
    steps.append(f"""gd AS (SELECT k, o, {at.format(x="x8")}, q * {e2}::DOUBLE AS u, {geo.B}::DOUBLE * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))) AS ba, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb,
        ba * (atan2(ss, cs) - bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1) - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) AS d FROM g8)""")
    steps.append(f"near AS (SELECT k, o, d FROM gd WHERE d <= {radius_m})")
    return ",\n    ".join(steps)


_EVENTS = """ev AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS event_id, l_suppkey AS o, CASE l_returnflag WHEN 'R' THEN 'losses' WHEN 'A' THEN 'kick' END AS risk_type, (l_quantity * 50)::DOUBLE AS md,
    l_tax > 0.05 AS pending, (1 - l_discount)::DOUBLE AS conf FROM lineitem WHERE l_tax <= 0.07)"""


def _offsets(f: dict[str, DataFrame], radius_m: float) -> DataFrame:
    return wells.offsets_within(f["wells"], f["wellbores"], f["stations"], _probes(f), f["events"], radius_m, depth=False, ordered=False)


@query("cq03_offsets", f"""
    WITH {_pairs_sql(120_000.0)}, {_EVENTS}, n AS (SELECT o, count(*) AS n FROM ev GROUP BY o)
    SELECT k::VARCHAR AS wellbore_id, near.o::VARCHAR AS other_id, round(d, 2) AS surface_m, coalesce(n, 0)::BIGINT AS n_events FROM near LEFT JOIN n ON n.o = near.o""")
def offsets(t: Tables) -> DataFrame:
    """The neighbours of every well within 120 km on the spheroid, with their events."""
    return _offsets(field(t), 120_000.0).select("wellbore_id", "other_id", F.round("surface_m", 2).alias("surface_m"), "n_events")


@query("cq03_offsets_depth")
def offsets_in_depth(t: Tables) -> DataFrame:
    """The same in space, 1,200 m down each well; the rule is tested on fixtures, as the neighbours' own depths have no short SQL."""
    f = field(t)
    out = wells.offsets_within(f["wells"], f["wellbores"], f["stations"], _probes(f), f["events"], 120_000.0, mode="depth", ordered=False)
    return out.select("wellbore_id", "other_id", F.round("surface_m", 2).alias("surface_m"), F.round("depth_m", 2).alias("depth_m"), "n_events")


@query("cq04_offset_events", f"""
    WITH {_pairs_sql(120_000.0)}, {_EVENTS}
    SELECT k::VARCHAR AS wellbore_id, near.o::VARCHAR AS other_id, event_id, md AS md_from_m FROM near JOIN ev ON ev.o = near.o
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, near.o::VARCHAR, md, event_id) <= 20""")
def offset_events(t: Tables) -> DataFrame:
    """The first 20 events of each well's neighbours, nearest well first, then by depth."""
    f = field(t)
    n = f["events"].where("review_status <> 'rejected'").groupBy("wellbore_id").agg(F.count(F.lit(1)).alias("weight"))
    near = wells.nearest_offsets(f["wells"], f["wellbores"], _probes(f), 120_000.0, 20, n)
    return wells.events_for_offsets(near, f["events"], limit=20, ordered=False).select("wellbore_id", "other_id", "event_id", "md_from_m")


@query("cq07_predicted_tops", f"""
    WITH {_pairs_sql(120_000.0)}, nearest AS (SELECT k, o, d FROM near QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, o::VARCHAR) <= 12),
    x AS (SELECT k, i, (600 * (i + 1) + o * 37 % 101)::DOUBLE AS v, 1 / greatest(d, 100) ^ 2 AS w FROM nearest, range(4) r(i)),
    a AS (SELECT *, sum(w) OVER p AS sw, sum(w * v) OVER p AS swv, count(*) OVER p AS n FROM x WINDOW p AS (PARTITION BY k, i)),
    b AS (SELECT *, swv / sw AS p, v - (swv - w * v) / (sw - w) AS e FROM a WHERE n >= 2),
    c AS (SELECT k, i, count(*) AS n, any_value(p) AS p, greatest(10, sqrt(sum(w * (v - p) ^ 2) / sum(w) + avg(e ^ 2))) AS u FROM b GROUP BY k, i),
    r AS (SELECT *, 5 * i + max(p - 5 * i) OVER (PARTITION BY k ORDER BY i) AS fixed FROM c)
    SELECT k::VARCHAR AS wellbore_id, ['Alpha', 'Beta', 'Gamma', 'Delta'][i + 1] AS formation, round(fixed, 2) AS top_md_m, round(u + fixed - p, 2) AS uncertainty_m, n::BIGINT AS n FROM r""")
def predicted_tops(t: Tables) -> DataFrame:
    """Tops predicted from the twelve nearest wells, in stratigraphic order, with their uncertainty."""
    f = field(t)
    out = wells.predict_tops(wells.nearest_offsets(f["wells"], f["wellbores"], _probes(f), 120_000.0, 12), f["tops"], f["order"])
    return out.select("wellbore_id", "formation", F.round("top_md_m", 2).alias("top_md_m"), F.round("uncertainty_m", 2).alias("uncertainty_m"), "n")


_AT = "floor(({md} - {k} * 37 % 101) / 600)::BIGINT - 1"


@query("cq08_lookahead_rates", f"""
    WITH {_pairs_sql(120_000.0)}, {_EVENTS},
    iv AS (SELECT s_suppkey AS k, {_AT.format(md="1200", k="s_suppkey")} AS i, (1200 - s_suppkey * 37 % 101 - 600 * (i + 1)) / 600.0 AS rel FROM supplier),
    e AS (SELECT *, least({_AT.format(md="md", k="o")}, 3) AS i, (md - o * 37 % 101 - 600 * (i + 1)) / 600.0 AS rel FROM ev),
    h AS (SELECT near.k, near.o, risk_type, conf, pending, exp(-d / 100 / {risk.L1_DECAY_M}) * CASE WHEN pending THEN {risk.PENDING_WEIGHT} ELSE 1 END AS w
          FROM near JOIN iv ON iv.k = near.k JOIN e ON e.o = near.o AND e.i = iv.i WHERE abs(e.rel - iv.rel) <= {risk.L1_REL_TOL} + {risk.EPS}),
    s AS (SELECT k, risk_type, sum(top) AS swh, sum(c) / sum(n) AS conf, sum(p) AS p FROM (SELECT k, o, risk_type, max(w) AS top, sum(conf) AS c, count(*) AS n, count(*) FILTER (pending) AS p FROM h GROUP BY ALL) GROUP BY k, risk_type),
    tot AS (SELECT k, sum(exp(-d / 100 / {risk.L1_DECAY_M})) AS sw, count(*) AS n FROM near GROUP BY k)
    SELECT s_suppkey::VARCHAR AS interval_id, r.risk_type, round(CASE WHEN sw > 0 THEN (coalesce(swh, 0) + {risk.L1_PRIOR_HIT}) / (sw + {risk.L1_PRIOR_WEIGHT}) END, 6) AS l1, coalesce(tot.n, 0)::BIGINT AS n_offsets,
           round(s.conf, 6) AS mean_conf, coalesce(s.p, 0)::BIGINT AS n_unreviewed
    FROM supplier CROSS JOIN (SELECT unnest({sorted(set(risk.RISK_OF_EVENT.values()))}) AS risk_type) r LEFT JOIN tot ON tot.k = s_suppkey LEFT JOIN s ON s.k = s_suppkey AND s.risk_type = r.risk_type""")
def lookahead_rates(t: Tables) -> DataFrame:
    """The hit rate of every risk 1,200 m down each well, by its neighbours' events at the same relative depth (distances a hundredth, so that they weigh)."""
    f = field(t)
    tops = f["tops"].select(F.col("wellbore_id"), "formation", "top_md_m")
    at = wells.formations(_probes(f), f["tops"])
    intervals = at.select(F.col("wellbore_id").alias("interval_id"), "formation", "relative_depth", F.col("md_m").alias("md_mid_m"), "top_md_m")
    seen = f["events"].withColumn("md_m", F.col("md_from_m").cast("double"))
    events = wells.formations(seen, f["tops"]).select("wellbore_id", "event_id", "risk_type", "formation", "relative_depth", F.col("md_m").alias("md_from_m"), "review_status", "confidence")
    out = lookahead.rates_within(intervals, wells.wellbore_points(f["wells"], f["wellbores"]), tops, events, 120_000.0, scale=0.01)
    return out.select("interval_id", "risk_type", F.round("l1", 6).alias("l1"), "n_offsets", F.round("mean_conf", 6).alias("mean_conf"), "n_unreviewed")


@query("cq09_stored_scores", f"""
    WITH c AS (SELECT s_suppkey AS k, 1000.0 + 25 * r.i AS md, CASE WHEN r.i = 0 THEN 0.8 END AS l3, ((s_suppkey * 7 + r.i) % 10) / 10.0 AS l1, s_suppkey % 4 AS n FROM supplier, range(0, 12) r(i) WHERE (s_suppkey + r.i) % 5 <> 0),
    n AS (SELECT k, md, 'kick' AS r, round(greatest(100 * (l1 * {risk.LAYER_WEIGHTS[0]} + coalesce(l3 * {risk.LAYER_WEIGHTS[2]}, 0)) / ({risk.LAYER_WEIGHTS[0]} + CASE WHEN l3 IS NULL THEN 0 ELSE {risk.LAYER_WEIGHTS[2]} END), CASE WHEN l3 IS NOT NULL THEN 50 ELSE 0 END), 6) AS fused, true AS fresh FROM c),
    o AS (SELECT s_suppkey AS k, 900.0 + 12.5 * r.i AS md, 'kick' AS r, 1.0 AS fused, false AS fresh FROM supplier, range(0, 20) r(i))
    SELECT k::VARCHAR AS wellbore_id, md::DOUBLE AS md_from_m, fused::DOUBLE AS fused, fresh FROM n UNION ALL SELECT k::VARCHAR, md::DOUBLE, fused::DOUBLE, fresh FROM o WHERE md < 1000""")
def stored_scores(t: Tables) -> DataFrame:
    """CQ-09: scores of the cells ahead, with a detector at the bit, stored over those of an older grid."""
    from wellframe.operators import scores

    k = F.col("s_suppkey")
    bits = t.supplier.select(k.cast("string").alias("wellbore_id"), F.lit(1012.0).alias("bit_md_m"))
    cell = t.supplier.select(k, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).where("(s_suppkey + i) % 5 <> 0")
    rates = cell.select(k.cast("string").alias("wellbore_id"), (1000.0 + 25 * F.col("i")).alias("md_from_m"), F.lit("kick").alias("risk_type"), ((k * 7 + F.col("i")) % 10 / 10.0).alias("l1"), (k % 4).alias("n_offsets"), F.lit(0.5).alias("mean_conf"))
    models = rates.select("wellbore_id", "md_from_m", "risk_type", F.lit(None).cast("double").alias("l2")).where("false")
    detectors = bits.select("wellbore_id", F.lit("kick").alias("risk_type"), F.lit(0.8).alias("l3"), F.lit(50.0).alias("floor"))
    new = scores.computed(bits, rates, models, detectors, F.timestamp_seconds(F.lit(2)))
    old = t.supplier.select(k.cast("string").alias("wellbore_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("wellbore_id", (900.0 + 12.5 * F.col("i")).alias("md_from_m"), F.lit(None).cast("double").alias("md_to_m"), F.lit("kick").alias("risk_type"), *[F.lit(None).cast("double").alias(c) for c in ("l1", "l2", "l3")], F.lit(1.0).alias("fused"), F.lit("low").alias("band"), F.lit("low").alias("confidence"), F.timestamp_seconds(F.lit(1)).alias("computed_at"))
    out = scores.stored(old, new, bits.select("wellbore_id", F.lit(1000.0).alias("start_m")))
    return out.select("wellbore_id", "md_from_m", F.round("fused", 6).alias("fused"), (F.col("computed_at") > F.timestamp_seconds(F.lit(1))).alias("fresh"))
