"""Further operators of the inventory on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import activity, citations, fuzzy, geo, risk, shapes
from wellframe.operators import evaluation, extraction, features, joins, matching, pages, windows
from wellframe.operators.stages import spread
from wellframe.plans.registry import Tables, query


def _r(col, digits: int = 4):
    return F.round(col, digits)


@query("pf07_counts_filter", "SELECT c_custkey, n::BIGINT AS n FROM customer JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND n > 0")
def counts_filter(t: Tables) -> DataFrame:
    n = t.orders.where("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.where("c_mktsegment = 'BUILDING'").join(n, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n")


@query("pf09_window_overlap", "SELECT p_partkey, greatest(0.0, least(p_size + 10.0, 40.0) - greatest(p_size, 25.0))::DOUBLE AS m FROM part WHERE greatest(0.0, least(p_size + 10.0, 40.0) - greatest(p_size, 25.0)) > 0")
def window_overlap(t: Tables) -> DataFrame:
    m = F.greatest(F.lit(0.0), F.least(F.col("p_size") + 10.0, F.lit(40.0)) - F.greatest(F.col("p_size").cast("double"), F.lit(25.0)))
    return t.part.select("p_partkey", m.alias("m")).where("m > 0")


@query("pf13_exists_null_page", """
    SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id AND (CASE WHEN c.turn > 0 THEN c.turn END IS NULL OR c.turn = length(d.source) - 3))""")
def exists_null_page(t: Tables) -> DataFrame:
    """A child on the same page, or on none, keeps the row."""
    c = t.conversations.select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") > 0, F.col("turn")).alias("page"))
    d = t.documents.select("doc_id", (F.length("source") - 3).alias("at"))
    hit = d.join(c, "doc_id").where(F.col("page").isNull() | (F.col("page") == F.col("at"))).select("doc_id").distinct()
    return t.documents.join(hit, "doc_id", "left_semi").select("doc_id")


@query("pf15_prefix_counter", "SELECT count(*)::BIGINT AS n FROM part WHERE p_name LIKE 'Part#0000001%' OR starts_with(p_brand, 'Brand#1')")
def prefix_counter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").startswith("Part#0000001") | F.col("p_brand").startswith("Brand#1")).agg(F.count(F.lit(1)).alias("n"))


_JN11_SQL = """
    WITH o AS (SELECT a.s_suppkey AS w, b.s_suppkey AS o, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
    SELECT w, l_orderkey, l_linenumber FROM o JOIN lineitem ON l_suppkey = o WHERE l_quantity > 49 AND d <= 500 QUALIFY row_number() OVER (PARTITION BY w ORDER BY d, o, l_orderkey, l_linenumber) <= 200"""


@query("jn11_events_of_offsets", _JN11_SQL)
def events_of_offsets(t: Tables) -> DataFrame:
    """The events of each well's offsets, nearest first, 200 of each well: the reference's limit is for one well."""
    events = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("other_id"), "l_orderkey", "l_linenumber")
    wells = t.supplier.select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_acctbal").join(events.groupBy(F.col("other_id").alias("id")).agg(F.count("*").alias("weight")), "id", "left")
    near = joins.nearest_in_band(wells, ["s_nationkey"], "s_acctbal", 500.0, 200)
    n = F.row_number().over(Window.partitionBy("id").orderBy("gap", "other_id", "l_orderkey", "l_linenumber"))
    return near.join(events, "other_id").withColumn("n", n).where("n <= 200").select(F.col("id").alias("w"), "l_orderkey", "l_linenumber")


@query("jn15_formation_asof", """
    WITH tops AS (SELECT p_brand, min(p_retailprice) AS top FROM part GROUP BY 1), p AS (SELECT s_suppkey, 900 + s_acctbal % 1200 AS md FROM supplier)
    SELECT s_suppkey, arg_max(p_brand, (top, p_brand)) AS formation FROM p LEFT JOIN tops ON top <= md GROUP BY 1""")
def formation_asof(t: Tables) -> DataFrame:
    """The deepest top above each probe."""
    tops = t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("md")).groupBy("md").agg(F.max("p_brand").alias("brand"))
    p = t.supplier.select("s_suppkey", (900 + F.col("s_acctbal") % 1200).alias("md"))
    return joins.asof_steps(p, tops, "md", ["brand"]).select("s_suppkey", F.col("asof_brand").alias("formation"))


_JN17_SQL = """
    WITH g AS (SELECT c_custkey AS k, 8000.0 + 250 * i AS a, 8250.0 + 250 * i AS b FROM customer, range(0, 8) r(i)),
    o AS (SELECT o_custkey AS k, o_orderkey, floor(epoch(o_orderdate))::DOUBLE / 86400 AS a, floor(epoch(o_orderdate))::DOUBLE / 86400 + 100 AS b FROM orders)
    SELECT g.k, g.a::DOUBLE AS a, arg_max(o_orderkey, (least(g.b, o.b) - greatest(g.a, o.a), o_orderkey)) AS best FROM g JOIN o ON g.k = o.k AND o.a < g.b AND o.b > g.a GROUP BY ALL"""


@query("jn17_best_overlap", _JN17_SQL)
def best_overlap(t: Tables) -> DataFrame:
    return _best_overlap(t, t.customer)


def _best_overlap(t: Tables, customer: DataFrame) -> DataFrame:
    """Each cell's row of the largest overlap, the latest on a tie."""
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double") / 86400
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", day.alias("r_from"), (day + 100).alias("r_to"))
    g = customer.select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    g = g.select("k", (8000.0 + 250 * F.col("i")).alias("l_from"), (8250.0 + 250 * F.col("i")).alias("l_to"))
    m = F.least("l_to", "r_to") - F.greatest("l_from", "r_from")
    rows = o.count() + 8 * customer.count()
    met = joins.overlap(g, o, ["k"], 250.0, rows=rows).select("k", F.col("l_from").alias("a"), "o_orderkey", m.alias("m"))
    return spread(met, ["k", "a"], rows).groupBy("k", "a").agg(F.max_by("o_orderkey", F.struct("m", "o_orderkey")).alias("best"))


@query("jn18_alert_hits", """
    WITH z AS (SELECT event_id, user_id, event_type, floor(epoch(ts)) AS s FROM events WHERE value > 60), e AS (SELECT event_id, user_id, event_type, floor(epoch(ts)) AS s FROM events WHERE value <= 5)
    SELECT e.event_id, bool_or(z.event_id IS NOT NULL) AS hit FROM e LEFT JOIN z ON z.user_id = e.user_id AND z.event_type = e.event_type AND z.s < e.s AND e.s - z.s <= 432000 GROUP BY 1""")
def alert_hits(t: Tables) -> DataFrame:
    """Whether an alert of the same kind was raised in the five days before each event."""
    e = t.events.select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    z = e.where("value > 60").select("user_id", "event_type", F.col("s").alias("zs"))
    ev = e.where("value <= 5").select("event_id", "user_id", "event_type", "s")
    hit = joins.band(ev, z, ["user_id", "event_type"], "s", "zs", 432000).where("zs < s").select("event_id").distinct().withColumn("hit", F.lit(True))
    return ev.join(hit, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("jn19_greedy_match")
def greedy_match(t: Tables) -> DataFrame:
    """One-to-one matching of returned and accepted lines of a supplier by quantity, the smallest gap first.

    Numbers of lines repeat, so a line is its order and number, and its place by quantity among equal ones.
    """
    line = ["l_orderkey", "l_linenumber"]
    x = t.lineitem.where("l_returnflag in ('R', 'A')").select(F.col("l_suppkey").alias("k"), "l_returnflag", *line, F.col("l_quantity").alias("x"))
    x = x.withColumn("copy", F.row_number().over(Window.partitionBy("k", "l_returnflag", *line).orderBy("x")))
    side = lambda flag: x.where(F.col("l_returnflag") == flag).select("k", F.struct(*line, "copy").alias("id"), "x")
    return matching.nearest(side("R"), side("A"), ["k"], "x", "id", 5.0).select("k", F.col("a.l_orderkey").alias("a"), F.col("b.l_orderkey").alias("b"))


def _found_and_true(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events with an odd id as predictions, the others as truth; pages are users, views and clicks are one risk."""
    risk = F.when(F.col("event_type").isin("view", "click"), "visit").when(F.col("event_type").isin("error", "signup"), "other")
    e = t.events.select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), "event_type", F.col("event_type").alias("formation"), risk.alias("risk"), F.col("value").alias("md"))
    return e.where("id % 2 = 1"), e.where("id % 2 = 0")


@query("jn20_matched_tops")
def matched_tops(t: Tables) -> DataFrame:
    """Each true top takes the first free prediction of its name within five metres."""
    predicted, truth = _found_and_true(t)
    return evaluation.matched_tops(predicted, truth)


@query("cq17_extraction_report")
def extraction_report(t: Tables) -> DataFrame:
    """Precision, recall and F1 of the matched events, by kind of document and for all."""
    predicted, truth = _found_and_true(t)
    pages = t.events.select(F.col("user_id").alias("page")).distinct().withColumn("doc_type", F.col("page") % 3)
    out = evaluation.extraction_report(predicted, truth, pages, 2.0)
    return out.select("doc_type", "found", "predicted", "truth", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


_CQ13_WELLS = """
    t AS (SELECT user_id AS well, event_id AS event, event_type AS risk, value * 10 AS a, value * 10 + 5 AS b FROM events WHERE event_id % 2 = 0),
    z AS (SELECT user_id AS well, event_id AS alert, event_type AS risk, value * 10 AS a, value * 10 + 20 AS b, value * 10 - 50 AS bit FROM events WHERE event_id % 2 = 1),
    w AS (SELECT DISTINCT user_id AS well, 100.0 AS start, 500.0 + user_id % 7 AS td FROM events),
    m AS (SELECT t.well, event, alert, bit, t.a FROM t JOIN z ON t.well = z.well AND t.risk = z.risk AND z.a <= t.b AND z.b >= t.a),
    e AS (SELECT well, event, a - min(bit) AS lead FROM m WHERE bit < a GROUP BY well, event, a),
    f AS (SELECT t.well, count(*) AS events, count(lead) AS hits, median(lead) AS lead_m FROM t JOIN w USING (well) LEFT JOIN e USING (well, event) WHERE t.a > start GROUP BY 1),
    g AS (SELECT z.well, count(*) AS alerts, count(*) FILTER (alert NOT IN (SELECT alert FROM m)) AS false_alerts FROM z GROUP BY 1)"""


def _alert_scores(t: Tables) -> DataFrame:
    md = F.col("value") * 10
    e = t.events.select(F.col("user_id").alias("well"), F.col("event_id").alias("event"), F.col("event_id").alias("alert"), F.col("event_type").alias("risk"), md.alias("md_from"), (md + 5).alias("md_to"), md.alias("zone_from"), (md + 20).alias("zone_to"), (md - 50).alias("bit"))
    wells = t.events.select(F.col("user_id").alias("well")).distinct().select("well", F.lit(100.0).alias("start"), (500.0 + F.col("well") % 7).alias("td"))
    return evaluation.alert_scores(e.where("event % 2 = 0"), e.where("alert % 2 = 1"), wells)


@query("cq13_alert_scores", f"""
    WITH {_CQ13_WELLS} SELECT well, coalesce(events, 0)::BIGINT AS events, coalesce(hits, 0)::BIGINT AS hits, coalesce(alerts, 0)::BIGINT AS alerts, coalesce(false_alerts, 0)::BIGINT AS false_alerts, round(lead_m, 4) AS lead_m, round(td - start, 4)::DOUBLE AS drilled_m
    FROM w LEFT JOIN f USING (well) LEFT JOIN g USING (well)""")
def alert_scores(t: Tables) -> DataFrame:
    """Hits, leads and false alerts of each well."""
    x = _alert_scores(t)
    median = x.select("well", F.explode("lead_m").alias("l")).groupBy("well").agg(F.median("l").alias("m"))
    return x.drop("lead_m").join(median, "well", "left").select("well", "events", "hits", "alerts", "false_alerts", _r(F.col("m"), 4).alias("lead_m"), _r(F.col("drilled_m"), 4).alias("drilled_m"))


@query("cq13_alert_report", f"""
    WITH {_CQ13_WELLS} SELECT (SELECT count(*) FROM w) AS wells, (SELECT sum(events) FROM f)::BIGINT AS events, (SELECT sum(hits) FROM f)::BIGINT AS hits, round((SELECT sum(hits) / sum(events) FROM f), 6) AS hit_rate,
    round((SELECT median(lead) FROM e JOIN t USING (well, event) JOIN w USING (well) WHERE t.a > start), 4) AS median_lead_m, (SELECT sum(alerts) FROM g)::BIGINT AS alerts, (SELECT sum(false_alerts) FROM g)::BIGINT AS false_alerts, round((SELECT sum(false_alerts) FROM g) * 1000 / (SELECT sum(td - start) FROM w), 6) AS false_per_1000m""")
def alert_report(t: Tables) -> DataFrame:
    """The same over all wells."""
    x = evaluation.alert_report(_alert_scores(t))
    return x.select("wells", "events", "hits", _r(F.col("hit_rate"), 6).alias("hit_rate"), _r(F.col("median_lead_m"), 4).alias("median_lead_m"), "alerts", "false_alerts", _r(F.col("false_per_1000m"), 6).alias("false_per_1000m"))


@query("jn22_stale_groups", "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) < 20")
def stale_groups(t: Tables) -> DataFrame:
    """Groups that no longer qualify: all less those that do."""
    good = t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n >= 20")
    return t.lineitem.select("l_partkey").distinct().join(good, "l_partkey", "left_anti")


@query("jn23_fuzzy_names", """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN n_nationkey WHEN 1 THEN n_nationkey WHEN 3 THEN n_nationkey END AS target FROM part JOIN nation ON n_nationkey = p_partkey % 25""")
def fuzzy_names(t: Tables) -> DataFrame:
    """JN-23, JN-24: names as they are but for case and spaces, with a slip, of no one, with a letter lost, and as near to two aliases."""
    name = F.concat("n_name", F.lit(" "), F.substring(F.md5(F.col("n_name").cast("binary")), 1, 12))
    known = t.nation.select(name.alias("alias"), F.col("n_nationkey").alias("target"))
    twins = t.nation.select(F.explode(F.array(F.concat(F.reverse(name), F.lit(" west")), F.concat(F.reverse(name), F.lit(" east")))).alias("alias"), F.col("n_nationkey").alias("k"))
    known = known.unionByName(twins.select("alias", (100 + F.col("k") + 100 * F.endswith("alias", F.lit("east")).cast("int")).alias("target")))
    k = F.col("p_partkey") % 5
    typed = F.when(k == 0, F.concat(F.lit(" "), F.upper(name))).when(k == 1, F.concat(F.substring(name, 1, 14), F.lit("z"), F.substring(name, 16, 20))).when(k == 2, F.repeat(F.lit("q"), 15)).when(k == 3, F.concat(F.substring(name, 1, 12), F.substring(name, 14, 20))).otherwise(F.concat(F.reverse(name), F.lit(" st")))
    parts = t.part.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("p_partkey") % 25).select("p_partkey", typed.alias("typed"))  # 25 nations
    return fuzzy.resolve(parts, "typed", known, "alias", "target").select("p_partkey", "target")


@query("ag17_success_rate", "SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS rate, len(list_distinct(list(o_orderpriority)))::INT AS kinds FROM orders GROUP BY 1")
def success_rate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(_r(F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 6).alias("rate"), F.size(F.collect_set("o_orderpriority")).alias("kinds"))


@query("ag28_counts", "SELECT 'status' AS what, o_orderstatus AS v, count(*)::BIGINT AS n FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def counts(t: Tables) -> DataFrame:
    """AG-25, AG-27, AG-28, AG-36: histograms of several columns in one pass."""
    both = F.array(F.struct(F.lit("status").alias("what"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("priority").alias("what"), F.col("o_orderpriority").alias("v")))
    return t.orders.select(F.inline(both)).groupBy("what", "v").agg(F.count(F.lit(1)).alias("n"))


@query("ag30_lead_stats", "SELECT event_type, round(median(value), 4) AS lead, round(1000.0 * count(*) FILTER (value > 40) / sum(value), 6) AS per_1000 FROM events GROUP BY 1")
def lead_stats(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(_r(F.median("value")).alias("lead"), _r(1000.0 * F.count_if(F.col("value") > 40) / F.sum("value"), 6).alias("per_1000"))


@query("ag39_max_within", "SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS best FROM events WHERE value <= 50 GROUP BY ALL")
def max_within(t: Tables) -> DataFrame:
    return t.events.where("value <= 50").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("tk01_case_sort", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY CASE WHEN l_linenumber > 3 THEN l_tax * 1000 ELSE l_quantity END, l_orderkey, l_linenumber LIMIT 30")
def case_sort(t: Tables) -> DataFrame:
    """TK-01, TK-03, TK-04."""
    d = F.when(F.col("l_linenumber") > 3, F.col("l_tax") * 1000).otherwise(F.col("l_quantity"))
    return t.lineitem.orderBy(d, "l_orderkey", "l_linenumber").limit(30).select("l_orderkey", "l_linenumber")


@query("tk09_severity_sort", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 50")
def severity_sort(t: Tables) -> DataFrame:
    """TK-08 to TK-10: rank, then age."""
    return t.orders.orderBy(risk.lookup(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1}, 2), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("snk03_upsert", """
    WITH old AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), new AS (SELECT l_suppkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
    SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new""")
def upsert(t: Tables) -> DataFrame:
    """SNK-03, SNK-04, SNK-06: new rows replace old ones of their key."""
    new = t.lineitem.where("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return old.join(new, "k", "left_anti").unionByName(new)


_SNK05_SQL = "SELECT c_custkey AS k FROM customer UNION SELECT DISTINCT o_custkey FROM orders"


@query("snk05_insert_absent", _SNK05_SQL)
def insert_absent(t: Tables) -> DataFrame:
    return _insert_absent(t.customer, t.orders)


def _insert_absent(customer: DataFrame, orders: DataFrame) -> DataFrame:
    old = customer.select(F.col("c_custkey").alias("k"))
    new = orders.select(F.col("o_custkey").alias("k")).distinct()
    return old.unionByName(new.join(old, "k", "left_anti"))


@query("snk07_purge", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice >= 200000 AND o_orderdate < TIMESTAMP '2022-01-01')")
def purge(t: Tables) -> DataFrame:
    return t.orders.where(~((F.col("o_totalprice") >= 200000) & (F.col("o_orderdate") < F.lit("2022-01-01").cast("timestamp_ntz")))).select("o_orderkey")


@query("snk08_derived_update", "SELECT p_partkey, greatest(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0), 20)::INT AS hole FROM part")
def derived_update(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.greatest(F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.lit(0)), F.lit(20)).alias("hole"))


@query("fn05_distance_3d", "SELECT s_suppkey, round(sqrt(s_acctbal ^ 2 + (s_suppkey * 3.0) ^ 2), 3) AS d FROM supplier")
def distance_3d(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", _r(geo.distance_3d(F.col("s_acctbal"), F.col("s_suppkey") * 3.0), 3).alias("d"))


@query("fn08_dogleg", """
    WITH x AS (SELECT p_partkey, p_size % 90 AS i0, (p_size * 7) % 90 AS i1, (p_size * 11) % 360 AS a0, (p_size * 13) % 360 AS a1 FROM part),
    b AS (SELECT p_partkey, acos(greatest(-1, least(1, cos(radians(i1) - radians(i0)) - sin(radians(i0)) * sin(radians(i1)) * (1 - cos(radians(a1 - a0)))))) AS b FROM x)
    SELECT p_partkey, round(b, 6) AS dogleg, round(CASE WHEN b < 1e-6 THEN 1 ELSE 2 / b * tan(b / 2) END, 5) AS rf FROM b""")
def dogleg(t: Tables) -> DataFrame:
    s = F.col("p_size")
    b = geo.dogleg_rad(s % 90, (s * 11) % 360, (s * 7) % 90, (s * 13) % 360)
    return t.part.select("p_partkey", b.alias("b")).select("p_partkey", _r(F.col("b"), 6).alias("dogleg"), _r(geo.ratio_factor(F.col("b")), 5).alias("rf"))


@query("fn02_project_round_trip", "SELECT s_suppkey, round(abs(s_acctbal), 2) AS d FROM supplier")
def project_round_trip(t: Tables) -> DataFrame:
    """FN-02, FN-03: a point projected and measured back on the spheroid gives the distance again."""
    lat, lon = F.lit(27.35), F.lit(95.3)
    x = t.supplier.select("s_suppkey", geo.project(lat, lon, (F.col("s_suppkey") % 360).cast("double"), F.abs("s_acctbal")).alias("p"))
    return x.select("s_suppkey", _r(geo.geodesic_m(lat, lon, F.col("p.lat"), F.col("p.lon")), 2).alias("d"))


@query("fn09_decay", "SELECT c_custkey, round(exp(-(c_custkey % 500) / 300.0), 8) AS decay, round(1 / greatest(c_custkey % 500, 100) ^ 2, 10) AS idw FROM customer")
def decay(t: Tables) -> DataFrame:
    d = (F.col("c_custkey") % 500).cast("double")
    return t.customer.select("c_custkey", _r(F.exp(-d / 300.0), 8).alias("decay"), _r(1 / F.pow(F.greatest(d, F.lit(100.0)), F.lit(2)), 10).alias("idw"))


@query("fn10_clip", "SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (l_quantity - 10) / 30)), 6) AS v FROM lineitem")
def clip(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", _r(risk.normalised(F.col("l_quantity"), 10.0, 40.0), 6).alias("v"))


@query("fn42_ages", "SELECT o_orderkey, floor(epoch(TIMESTAMP '2000-01-01'))::BIGINT - floor(epoch(o_orderdate))::BIGINT AS age_s, o_orderdate BETWEEN TIMESTAMP '1950-01-01' AND TIMESTAMP '1996-12-31' AS valid FROM orders")
def ages(t: Tables) -> DataFrame:
    """FN-42 to FN-44."""
    d = F.col("o_orderdate").cast("timestamp")
    return t.orders.select("o_orderkey", (F.unix_seconds(F.lit("2000-01-01").cast("timestamp")) - F.unix_seconds(d)).alias("age_s"), F.col("o_orderdate").between(F.lit("1950-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")).alias("valid"))


@query("fn45_age_label", "SELECT event_id, CASE WHEN value < 60 THEN printf('%02d:%02d', floor(value)::INT, 0) ELSE printf('%dh %02dm', (floor(value)::INT // 60), (floor(value)::INT % 60)) END AS label FROM events")
def age_label(t: Tables) -> DataFrame:
    m = F.floor("value").cast("int")
    return t.events.select("event_id", F.when(F.col("value") < 60, F.format_string("%02d:%02d", m, F.lit(0))).otherwise(F.format_string("%dh %02dm", F.floor(m / 60).cast("int"), m % 60)).alias("label"))


@query("fn36_titles", "SELECT o_orderkey, concat_ws(' ', upper(o_orderpriority), 'risk ahead at', (round_even(o_totalprice / 5, 0) * 5)::BIGINT::VARCHAR, 'm') AS title FROM orders")
def titles(t: Tables) -> DataFrame:
    """FN-24, FN-36: rendered sentences, depths rounded half to even to five metres."""
    five = (F.bround(F.col("o_totalprice") / 5) * 5).cast("bigint").cast("string")
    return t.orders.select("o_orderkey", F.concat_ws(" ", F.upper("o_orderpriority"), F.lit("risk ahead at"), five, F.lit("m")).alias("title"))


@query("fn47_reason_concat", "SELECT o_custkey, len(list_concat(list_sort(list(DISTINCT o_orderpriority))[1:2], ['detector']))::INT AS n, list_sort(list(DISTINCT o_orderpriority))[1] AS first_ FROM orders GROUP BY 1")
def reason_concat(t: Tables) -> DataFrame:
    p = F.array_sort(F.collect_set("o_orderpriority"))
    x = t.orders.groupBy("o_custkey").agg(p.alias("p"))
    return x.select("o_custkey", F.size(F.concat(F.slice("p", 1, 2), F.array(F.lit("detector")))).alias("n"), F.col("p")[0].alias("first_"))


@query("fn53_severity_cap", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'watch' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END END AS severity FROM orders")
def severity_cap(t: Tables) -> DataFrame:
    sev = risk.lookup(F.col("o_orderpriority"), {"1-URGENT": "critical", "2-HIGH": "warning"}, "info")
    conf = F.when(F.col("o_orderkey") % 3 == 0, "low").otherwise("high")
    return t.orders.select("o_orderkey", risk.cap_severity(sev, conf, F.col("o_orderstatus") == "F").alias("severity"))


@query("fn55_combine", "SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN p_retailprice / 2000 ELSE 0.6 * p_size / 50 + 0.4 * p_retailprice / 2000 END, 6) AS p FROM part")
def combine(t: Tables) -> DataFrame:
    l1, l2 = F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 50), F.col("p_retailprice") / 2000
    return t.part.select("p_partkey", _r(F.when(l1.isNull(), l2).otherwise(0.6 * l1 + 0.4 * l2), 6).alias("p"))


@query("st11_due_updates", """
    WITH x AS (SELECT user_id, event_id, floor(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 500) AS b, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id FROM (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY n) AS pb, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY n) AS pe FROM x) WHERE pb IS NULL OR b > pb OR (event_type = 'error') <> pe""")
def due_updates(t: Tables) -> DataFrame:
    """Recompute on every new stretch of depth or when the fired set changes."""
    w = windows.series(["user_id"], ["ts", "event_id"])
    x = t.events.withColumn("b", F.floor(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 500))
    x = x.withColumn("pb", F.lag("b").over(w)).withColumn("pe", F.lag(F.col("event_type") == "error").over(w))
    return x.where(F.col("pb").isNull() | (F.col("b") > F.col("pb")) | ((F.col("event_type") == "error") != F.col("pe"))).select("event_id")


@query("st13_current_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1")
def current_state(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.max_by("value", F.struct("ts", "event_id")).alias("v"))


@query("st12_dropped_window", "SELECT event_id FROM events WHERE NOT (user_id % 7 = 0 AND epoch(ts) % 86400 BETWEEN 3600 AND 7200)")
def dropped_window(t: Tables) -> DataFrame:
    """Samples of a dropped window are lost, not replayed later."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.where(~((F.col("user_id") % 7 == 0) & (s % 86400).between(3600, 7200))).select("event_id")


@query("cm13_retry", "SELECT o_custkey, CASE WHEN arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' THEN 'retry' ELSE 'duplicate' END AS action FROM orders GROUP BY 1")
def retry(t: Tables) -> DataFrame:
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.when(last == "F", "retry").otherwise("duplicate").alias("action"))


@query("cq12_labels", """
    WITH e AS (SELECT user_id, event_type, floor(epoch(ts)) AS s FROM events)
    SELECT DISTINCT g.user_id, g.s::BIGINT AS s, e.event_type FROM (SELECT user_id, s FROM e WHERE event_type = 'view') g JOIN e ON e.user_id = g.user_id AND e.event_type <> 'view' AND e.s BETWEEN g.s + 50000 AND g.s + 300000""")
def labels(t: Tables) -> DataFrame:
    """Look-ahead labels, both ends of the window included."""
    e = t.events.select("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    g = e.where("event_type = 'view'").select("user_id", "s", (F.col("s") + 175000).alias("mid"))
    h = e.where("event_type <> 'view'").select("user_id", "event_type", F.col("s").alias("es"))
    return joins.band(g, h, ["user_id"], "mid", "es", 125000).select("user_id", "s", "event_type").distinct()


@query("fn35_checked_answers", """
    SELECT p_partkey, 'It was ' || p_size || ' m [1].' || CASE WHEN p_partkey % 2 = 0 THEN ' Then ' || p_size || ' m [2].' ELSE '' END || ' End.' AS answer, p_partkey % 2 = 1 AS removed, (p_partkey % 2)::INT AS n_unsupported, 1::INT AS n_uncited FROM part""")
def checked_answers(t: Tables) -> DataFrame:
    """FN-23, FN-35: citations of no source go, then sentences whose numbers are not in what they cite."""
    size = F.col("p_size").cast("string")
    second = F.when(F.col("p_partkey") % 2 == 0, size).otherwise((F.col("p_size") + 1).cast("string"))
    raw = F.concat(F.lit("It was "), size, F.lit(" metres [1, 9]. Then "), second, F.lit(" m [2]. End [9]."))
    answers = t.part.select("p_partkey", F.replace(citations.cleaned(raw, F.array(F.lit(1), F.lit(2))), F.lit("metres"), F.lit("m")).alias("answer"))
    sources = t.part.select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.concat(F.lit("At "), size, F.lit(" m it stopped.")).alias("text"))
    out = citations.checked(answers, sources, "p_partkey", "answer", "n", "text")
    return out.select("p_partkey", "answer", "removed", F.size("unsupported").alias("n_unsupported"), F.size("uncited").alias("n_uncited"))


_MD = "(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600.0"


@query("cq12_features", f"""
    WITH e AS (SELECT user_id, event_id, event_type, value, {_MD} AS md FROM events), g AS (SELECT DISTINCT user_id, 50.0 * k AS md0 FROM e, range(0, 15) r(k)),
    w AS (SELECT g.user_id, md0, count(value) AS n, avg(value) AS m, regr_slope(value, md) * 30 AS s FROM g JOIN e ON e.user_id = g.user_id AND md <= md0 AND md > md0 - 30 AND event_type IN ('view', 'click') GROUP BY ALL),
    k AS (SELECT g.user_id, md0, arg_max(value, md) FILTER (event_type = 'error') AS mw, arg_max(md, md) FILTER (event_type = 'signup') AS smd, arg_max(md, md) FILTER (event_type = 'purchase') AS top, arg_max(event_id % 4, md) FILTER (event_type = 'purchase') AS fm FROM g JOIN e ON e.user_id = g.user_id AND md <= md0 GROUP BY ALL)
    SELECT g.user_id, g.md0::DOUBLE AS md_from_m, round(mw, 6)::DOUBLE AS mw_sg, round(smd * 0.9 + (g.md0 - smd) * cos(radians(10)), 4)::DOUBLE AS tvd_m, 'F' || fm AS formation, round(top, 4)::DOUBLE AS top_md_m,
           CASE WHEN n >= 3 THEN round(m, 5) END::DOUBLE AS rop_mean, CASE WHEN n >= 3 THEN round(s, 4) END::DOUBLE AS rop_slope FROM g LEFT JOIN w USING (user_id, md0) LEFT JOIN k USING (user_id, md0)""")
def base_features(t: Tables) -> DataFrame:
    """Every user as a well, its events by hour as depths: what is known at each grid point, from one sorted pass."""
    md = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200) / 3600
    e = t.events.select(F.col("user_id").alias("wellbore_id"), "event_id", "event_type", "value", md.alias("md_m"))
    grid = e.select("wellbore_id").distinct().select("wellbore_id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("k")).select("wellbore_id", (50.0 * F.col("k")).alias("md_from_m"))
    series = e.select("wellbore_id", "md_m", F.when(F.col("event_type").isin("view", "click"), F.col("value")).alias("rop"), F.when(F.col("event_type") == "error", F.col("value")).alias("mw_sg"))
    stations = e.where("event_type = 'signup'").select("wellbore_id", "md_m", (F.col("md_m") * 0.9).alias("tvd_m"), F.lit(10.0).alias("inc_deg"))
    tops = e.where("event_type = 'purchase'").select("wellbore_id", F.concat(F.lit("F"), (F.col("event_id") % 4).cast("string")).alias("formation"), F.col("md_m").alias("top_md_m"))
    sections = e.select("wellbore_id", F.col("md_m").alias("md_from_m"), F.col("md_m").alias("md_to_m"), F.lit(0.0).alias("hole_size_in")).where("false")
    out = features.base(grid, series, stations, tops, sections, ["rop"], ["mw_sg"])
    return out.select(F.col("wellbore_id").alias("user_id"), "md_from_m", _r(F.col("mw_sg"), 6).alias("mw_sg"), _r(F.col("tvd_m")).alias("tvd_m"), "formation", _r(F.col("top_md_m")).alias("top_md_m"), _r(F.col("rop_mean_30m"), 5).alias("rop_mean"), _r(F.col("rop_slope_30m")).alias("rop_slope"))


@query("fn38_reading_order", """
    WITH b AS (SELECT l_orderkey AS page, l_shipmode AS text, l_linenumber / 2 AS y, l_partkey AS x FROM (SELECT *, substr(md5(l_partkey || '-' || l_suppkey), 1, 4) AS l_shipmode FROM lineitem))
    SELECT page, (dense_rank() OVER (PARTITION BY page ORDER BY floor(y)) - 1)::BIGINT AS line, string_agg(text, ' ' ORDER BY x, text) AS text FROM b GROUP BY page, floor(y)""")
def reading_order(t: Tables) -> DataFrame:
    """Lines of an order as boxes of a page: two line numbers each make a line of text."""
    text = F.substring(F.md5(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).cast("binary")), 1, 4)
    boxes = t.lineitem.select(F.col("l_orderkey").alias("page"), text.alias("text"), F.col("l_partkey").alias("x"), (F.floor(F.col("l_linenumber") / 2) + (F.col("l_linenumber") % 2) * 0.1).alias("y"), F.lit(1.0).alias("w"), F.lit(0.9).alias("h"))
    return pages.reading_order(boxes, "page")


@query("fn37_page_windows")
def page_windows(t: Tables) -> DataFrame:
    """Documents as pages, a hundred to a report, in windows of 12,000 characters; the running rule has no SQL."""
    d = t.documents.select(F.floor(F.col("doc_id") / 100).alias("doc"), (F.col("doc_id") % 100).alias("page"), "text")
    return pages.page_windows(d, "doc", "page", "text")


#: What a log line says, and its code.
_LINES = [("Fishing for junk", 19), ("shut-in, kick", 27), ("back reaming", 3), ("WOC", 13), ("drilled ahead, losses", 24), ("losses while circulating", 5), ("RIH", 6), ("idle", None)]


@query("fn34_activity_codes", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % {len(_LINES)} {" ".join(f"WHEN {i} THEN {c}" for i, (_, c) in enumerate(_LINES) if c)} END::INT AS code FROM lineitem""")
def activity_codes(t: Tables) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x, _ in _LINES]), (F.col("l_partkey") % len(_LINES) + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", activity.code(text).alias("code"))


@query("fn49_shapes", """
    SELECT event_id, array_to_string(list_filter([CASE WHEN (props->>'k')::INT % 3 = 0 THEN 'k: missing (int)' WHEN (props->>'k')::INT % 3 = 1 THEN 'k: expected int, got ' || (props->>'k') || '.5' END,
        CASE WHEN event_type NOT IN ('view', 'click') THEN 'kind: ' || event_type || ' is not one of view|click' END], lambda x: x IS NOT NULL), '; ') AS problems FROM events""")
def shape_problems(t: Tables) -> DataFrame:
    """Rows as JSON with a number that is missing or no whole one, and a choice that is none."""
    k = F.get_json_object("props", "$.k")
    row = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('"'), F.when(k.cast("int") % 3 == 0, "").when(k.cast("int") % 3 == 1, F.concat(F.lit(', "k": '), k, F.lit(".5"))).otherwise(F.concat(F.lit(', "k": '), k)), F.lit("}"))
    p = shapes.problems(F.try_parse_json(row), {"k": "int", "kind": ["view", "click"]})
    return t.events.select("event_id", F.array_join(p, "; ").alias("problems"))


@query("cq18_validated_items", """
    WITH x AS (SELECT p_partkey, p_size * 10 AS md, p_partkey % 4 AS k FROM part)
    SELECT p_partkey, 'events' AS kind, k <> 0 AS accepted, CASE WHEN k <> 0 THEN md END::DOUBLE AS md_from_m, CASE WHEN k = 0 THEN '' ELSE concat_ws(',', CASE WHEN md > 300 THEN 'depth out of range' END, CASE WHEN k = 1 THEN 'snippet not on page' END) END AS failed,
           CASE WHEN k = 0 THEN 'rejected' WHEN md > 300 OR k = 1 THEN 'pending' ELSE 'auto_approved' END AS status FROM x
    UNION ALL SELECT p_partkey, 'time_log', false, NULL, '', 'rejected' FROM x""")
def validated_items(t: Tables) -> DataFrame:
    """CQ-18: items of JSON payloads, accepted with failed rules or refused, from one scan."""
    k, md = F.col("p_partkey") % 4, (F.col("p_size") * 10).cast("string")
    kind = F.when(k == 0, "nonsense").otherwise(next(iter(risk.RISK_OF_EVENT)))
    says = F.when(k == 1, "never written anywhere on it").otherwise(F.concat(F.lit("losses seen at "), md, F.lit(" m")))
    event = F.struct(kind.alias("event_type"), md.cast("double").alias("md_from_m"), F.lit(1).alias("page"), says.alias("snippet"), F.lit(0.9).alias("confidence"))
    line = F.struct(F.lit("Drilled").alias("description"), F.lit("high").alias("confidence"))
    docs = t.part.select("p_partkey", F.to_json(F.struct(F.array(event).alias("events"), F.array(line).alias("time_log"))).alias("payload"))
    pages = t.part.select("p_partkey", F.lit(1).alias("page"), F.concat(F.lit("Mud losses  seen at "), md, F.lit(" m, cured.")).alias("text"), F.lit(1.0).alias("ocr_confidence"))
    depths = t.part.select("p_partkey", F.lit(300.0).alias("td_md_m"))
    known = t.nation.select(F.col("n_name").alias("alias"), F.col("n_name").alias("formation"))
    out = extraction.validated(docs, "p_partkey", "payload", pages, depths, known)
    return out.select("p_partkey", "kind", "accepted", F.try_element_at("values", F.lit("md_from_m")).alias("md_from_m"), F.array_join("failed", ",").alias("failed"), "status")
