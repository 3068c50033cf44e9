"""Filters, joins, aggregations, sorts and set operations on the driver's tables.

Wells are customers, hazard events are orders and their lines, risk types are order priorities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import geo, risk
from wellframe.operators import aggregates, joins, restql
from wellframe.plans.registry import Tables, query

_OC = "orders o JOIN customer c ON o.o_custkey = c.c_custkey"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _r(col, digits: int = 2):
    return F.round(col, digits)


@query("ag03_npt_rollup", f"""
    SELECT n_name, o_orderpriority, count(*)::BIGINT AS n_lines, round(sum(l_extendedprice), 2) AS hours, count(DISTINCT c_custkey)::BIGINT AS n_wells
    FROM {_OC} JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def npt_rollup(t: Tables) -> DataFrame:
    """Lines, summed price and distinct customers by nation and priority, without one status."""
    o = t.orders.where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = t.lineitem.select("l_orderkey", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_lines"), _r(F.sum("l_extendedprice")).alias("hours"), F.countDistinct("c_custkey").alias("n_wells"))


@query("ag01_summary_left", """
    SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders, coalesce(s, 0.0) AS total FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) n, round(sum(o_totalprice), 2) s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def summary_left(t: Tables) -> DataFrame:
    """Every customer with its orders, zero where it has none: aggregated before the join."""
    agg = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice")).alias("s"))
    j = t.customer.join(agg, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit(0.0)).alias("total"))


@query("ag02_mode_tiebreak", """
    SELECT user_id, event_type AS top_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) k
    FROM events GROUP BY user_id, event_type) WHERE k = 1""")
def mode_tiebreak(t: Tables) -> DataFrame:
    return aggregates.mode_first(t.events, ["user_id"], "event_type", "top_type")


@query("ag04_correlated_count", """
    SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'R')::BIGINT AS n FROM part""")
def correlated_count(t: Tables) -> DataFrame:
    n = t.lineitem.where("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


_PRED = """
    SELECT n_nationkey AS key, s_acctbal AS v, abs(s_suppkey % 37) * 40.0 AS d FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


@query("ag05_weighted_prediction", f"""
    WITH x AS (SELECT key, v, 1 / greatest(d, 100.0) ^ 2 AS w FROM ({_PRED})),
    a AS (SELECT *, sum(w) OVER p AS sw, sum(w * v) OVER p AS swv, count(*) OVER p AS n FROM x WINDOW p AS (PARTITION BY key)),
    b AS (SELECT *, swv / sw AS p, v - (swv - w * v) / (sw - w) AS e FROM a WHERE n >= 2)
    SELECT key, count(*)::BIGINT AS n, round(any_value(p), 3) AS predicted, round(sqrt(sum(w * (v - p) ^ 2) / sum(w)), 3) AS spread, round(sqrt(avg(e ^ 2)), 3) AS loo_rmse,
           round(greatest(10.0, sqrt(sum(w * (v - p) ^ 2) / sum(w) + avg(e ^ 2))), 3) AS uncertainty FROM b GROUP BY key""")
def weighted_prediction(t: Tables) -> DataFrame:
    """AG-05 to AG-09: inverse-distance mean, spread, leave-one-out error, uncertainty, two offsets at least."""
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_nationkey").alias("key"), F.col("s_acctbal").alias("v"), (F.abs(F.col("s_suppkey") % 37) * 40.0).alias("d"))
    out = aggregates.weighted_prediction(rows, ["key"], "v", "d")
    return out.select("key", "n", *[_r(c, 3).alias(c) for c in ("predicted", "spread", "loo_rmse", "uncertainty")])


@query("ag10_l1_rate", """
    WITH o AS (SELECT c_custkey, c_nationkey, exp(-(c_custkey % 50) * 100.0 / 3000.0) AS w FROM customer),
    h AS (SELECT o_custkey, o_orderpriority AS risk, max(CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 1.0 END) AS hit FROM orders WHERE o_totalprice > 150000 GROUP BY ALL),
    g AS (SELECT c_nationkey, risk, w, c_custkey FROM o CROSS JOIN (SELECT DISTINCT o_orderpriority AS risk FROM orders))
    SELECT g.c_nationkey, g.risk, round((sum(w * coalesce(hit, 0)) + 0.5) / (sum(w) + 1.0), 6) AS l1, count(*)::BIGINT AS n_offsets
    FROM g LEFT JOIN h ON h.o_custkey = g.c_custkey AND h.risk = g.risk GROUP BY ALL""")
def l1_rate(t: Tables) -> DataFrame:
    """Smoothed, distance-weighted share of offsets with a hit; of an offset's hits only the strongest counts."""
    w = t.customer.select("c_custkey", "c_nationkey", F.exp(-(F.col("c_custkey") % 50) * 100.0 / risk.L1_DECAY_M).alias("w"))
    hit = t.orders.where("o_totalprice > 150000").groupBy("o_custkey", F.col("o_orderpriority").alias("risk")).agg(F.max(F.when(F.col("o_orderstatus") == "P", risk.PENDING_WEIGHT).otherwise(1.0)).alias("hit"))
    # The denominator doesn't depend on the risk: offsets are summed once and joined to the hits' sums.
    den = w.groupBy("c_nationkey").agg(F.sum("w").alias("sw"), F.count(F.lit(1)).alias("n_offsets"))
    num = hit.join(w, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "risk").agg(F.sum(F.col("w") * F.col("hit")).alias("swh"))
    grid = den.crossJoin(F.broadcast(t.spark.createDataFrame([(p,) for p in PRIORITIES], "risk string")))
    out = grid.join(num, ["c_nationkey", "risk"], "left")
    return out.select("c_nationkey", "risk", _r((F.coalesce("swh", F.lit(0.0)) + risk.L1_PRIOR_HIT) / (F.col("sw") + risk.L1_PRIOR_WEIGHT), 6).alias("l1"), "n_offsets")


_LAYERS = "CASE WHEN l_quantity > 10 THEN l_quantity / 50 END AS l1, CASE WHEN l_linenumber > 2 THEN l_discount * 10 END AS l2, CASE WHEN l_returnflag = 'R' THEN l_tax * 12 END AS l3"


@query("ag12_fuse", f"""
    WITH x AS (SELECT l_orderkey, l_linenumber, {_LAYERS}, CASE WHEN l_linestatus = 'O' THEN 65.0 END AS fl FROM lineitem),
    y AS (SELECT *, (coalesce(0.5 * l1, 0) + coalesce(0.3 * l2, 0) + coalesce(0.2 * l3, 0)) / nullif((CASE WHEN l1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN l2 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN l3 IS NULL THEN 0 ELSE 0.2 END)::DOUBLE, 0) AS m FROM x),
    z AS (SELECT *, CASE WHEN m IS NOT NULL THEN round(greatest(100.0 * greatest(0.0, least(1.0, m)), coalesce(fl, 0.0)), 4) END AS fused FROM y)
    SELECT l_orderkey, l_linenumber, fused, CASE WHEN fused <= 20 THEN 'low' WHEN fused <= 40 THEN 'moderate' WHEN fused <= 60 THEN 'elevated' WHEN fused <= 80 THEN 'high' WHEN fused IS NOT NULL THEN 'critical' END AS band,
        CASE WHEN fused <= 20 THEN NULL WHEN fused <= 40 THEN 'info' WHEN fused <= 60 THEN 'watch' WHEN fused <= 80 THEN 'warning' WHEN fused IS NOT NULL THEN 'critical' END AS severity FROM z""")
def fuse(t: Tables) -> DataFrame:
    """AG-12, PF-10: layers fused over those present, floor, band and severity."""
    l1 = F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 50)
    l2 = F.when(F.col("l_linenumber") > 2, F.col("l_discount") * 10)
    l3 = F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 12)
    fused = F.round(risk.fuse([l1, l2, l3], F.when(F.col("l_linestatus") == "O", 65.0)), 4)
    out = t.lineitem.select("l_orderkey", "l_linenumber", fused.alias("fused")).withColumn("band", risk.band(F.col("fused")))
    return out.withColumn("severity", risk.severity(F.col("band")))


@query("ag14_highest_floor", """
    SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS floor FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def highest_floor(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus = 'F'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"), F.max("o_totalprice").alias("floor"))


@query("ag15_having_distinct", """
    SELECT l_partkey, count(*)::BIGINT AS n, count(DISTINCT l_suppkey)::BIGINT AS n_wells FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_suppkey) >= 2""")
def having_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("n_wells")).where("n >= 2 and n_wells >= 2")


@query("ag16_capped_list", """
    WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) k FROM conversations WHERE text IS NOT NULL),
    s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY k) c FROM r WHERE k <= 4)
    SELECT conv_id, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM s WHERE c <= 800 GROUP BY 1""")
def capped_list(t: Tables) -> DataFrame:
    """The most recent turns of a conversation, four and 800 characters at most."""
    out = aggregates.capped_list(t.conversations.where("text is not null"), ["conv_id"], [F.desc("turn")], "text", 4, 800)
    return out.select("conv_id", F.size("texts").cast("long").alias("n"), F.aggregate("texts", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query("ag18_median_gap", """
    WITH g AS (SELECT p_brand, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - p_retailprice AS gap FROM part)
    SELECT p_brand, round(median(gap), 4) AS median_gap FROM g WHERE gap > 0 GROUP BY 1""")
def median_gap(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    g = t.part.select("p_brand", (F.lead("p_retailprice").over(w) - F.col("p_retailprice")).alias("gap")).where("gap > 0")
    return g.groupBy("p_brand").agg(_r(F.median("gap"), 4).alias("median_gap"))


@query("ag19_metrics_unknown", """
    SELECT coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'Unknown') AS field, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1""")
def metrics_unknown(t: Tables) -> DataFrame:
    field = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit("Unknown"))
    return t.customer.groupBy(field.alias("field")).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("c_acctbal")).alias("total"))


_PIVOT = ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS p{i + 1}" for i, p in enumerate(PRIORITIES))


@query("ag20_pivot", f"SELECT c_nationkey, {_PIVOT} FROM {_OC} GROUP BY 1")
def pivot(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = j.groupBy("c_nationkey").pivot("o_orderpriority", PRIORITIES).agg(_r(F.sum("o_totalprice")))
    return out.withColumnsRenamed({p: f"p{i + 1}" for i, p in enumerate(PRIORITIES)})


@query("ag21_open_counts", """
    SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS critical, count(*) FILTER (o_orderpriority = '2-HIGH')::BIGINT AS warning, count(*)::BIGINT AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def open_counts(t: Tables) -> DataFrame:
    c = lambda p, n: F.count_if(F.col("o_orderpriority") == p).alias(n)
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(c("1-URGENT", "critical"), c("2-HIGH", "warning"), F.count(F.lit(1)).alias("total"))


@query("ag22_dashboard", """
    SELECT count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS high, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 4) AS live_pct, round(sum(o_totalprice), 2) AS npt FROM orders""")
def dashboard(t: Tables) -> DataFrame:
    live = F.count_if(F.col("o_orderstatus") == "O")
    return t.orders.agg(live.alias("open"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("high"), _r(100.0 * live / F.count(F.lit(1)), 4).alias("live_pct"), _r(F.sum("o_totalprice")).alias("npt"))


@query("ag23_response_time", """
    SELECT o_orderpriority, round(avg(date_diff('second', o_orderdate, l_shipdate)), 2) AS mean_s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1""")
def response_time(t: Tables) -> DataFrame:
    j = t.orders.join(t.lineitem.select("l_orderkey", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    s = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return j.groupBy("o_orderpriority").agg(_r(F.avg(s)).alias("mean_s"))


@query("ag24_count_mapped", """
    SELECT CASE event_type WHEN 'error' THEN 'losses' WHEN 'purchase' THEN 'kick' ELSE 'other' END AS risk, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def count_mapped(t: Tables) -> DataFrame:
    return t.events.groupBy(risk.lookup(F.col("event_type"), {"error": "losses", "purchase": "kick"}, "other").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("ag26_review_queue", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS pending, min(epoch(o_orderdate))::BIGINT AS oldest FROM orders GROUP BY 1")
def review_queue(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.min(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("oldest"))


@query("ag31_coverage_mae", "SELECT l_returnflag, round(avg(abs(l_quantity - 25)), 4) AS mae, round(count(*) FILTER (abs(l_quantity - 25) <= 10)::DOUBLE / count(*), 6) AS coverage FROM lineitem GROUP BY 1")
def coverage_mae(t: Tables) -> DataFrame:
    e = F.abs(F.col("l_quantity") - 25)
    return t.lineitem.groupBy("l_returnflag").agg(_r(F.avg(e), 4).alias("mae"), _r(F.count_if(e <= 10) / F.count(F.lit(1)), 6).alias("coverage"))


@query("ag32_precision_recall", """
    WITH x AS (SELECT source, l.quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM documents d JOIN labels l USING (doc_id)),
    g AS (SELECT coalesce(source, 'all') AS grp, sum(y * p)::BIGINT AS tp, sum(p)::BIGINT AS pp, sum(y)::BIGINT AS ap FROM x GROUP BY ROLLUP (source))
    SELECT grp, tp, round(tp / nullif(pp, 0)::DOUBLE, 6) AS precision_, round(tp / nullif(ap, 0)::DOUBLE, 6) AS recall, round(2.0 * tp / nullif(pp + ap, 0), 6) AS f1 FROM g""")
def precision_recall(t: Tables) -> DataFrame:
    """By source and overall in one rollup."""
    x = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").withColumn("p", (F.col("n_chars") > 800).cast("long"))
    g = x.rollup("source").agg(F.sum(F.col("quality") * F.col("p")).alias("tp"), F.sum("p").alias("pp"), F.sum(F.col("quality").cast("long")).alias("ap"))
    nz = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    return g.select(F.coalesce("source", F.lit("all")).alias("grp"), "tp", _r(F.col("tp") / nz(F.col("pp")), 6).alias("precision_"), _r(F.col("tp") / nz(F.col("ap")), 6).alias("recall"), _r(2.0 * F.col("tp") / nz(F.col("pp") + F.col("ap")), 6).alias("f1"))


@query("ag33_average_precision", """
    WITH x AS (SELECT source, n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT source, s, sum(y) tp, count(*) n FROM x GROUP BY ALL),
    c AS (SELECT *, sum(tp) OVER w ctp, sum(n) OVER w cn FROM g WINDOW w AS (PARTITION BY source ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
    SELECT source, round(sum(tp * ctp / cn::DOUBLE) / nullif(sum(tp), 0), 6) AS average_precision FROM c GROUP BY 1""")
def average_precision(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    return aggregates.average_precision(x, ["source"], "n_chars", "toxic").withColumn("average_precision", _r(F.col("average_precision"), 6))


@query("ag34_error_rate", "SELECT c_custkey, round(levenshtein(c_name, 'Customer#000000001') / length(c_name)::DOUBLE, 6) AS cer FROM customer")
def error_rate(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", _r(F.levenshtein("c_name", F.lit("Customer#000000001")) / F.length("c_name"), 6).alias("cer"))


@query("ag35_all_true", "SELECT user_id, bool_and(value > 1) AS all_big, bool_or(event_type = 'error') AS any_error FROM events GROUP BY 1")
def all_true(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.bool_and(F.col("value") > 1).alias("all_big"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query("ag37_having_left", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 8")
def having_left(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n")).where("n < 8")


@query("ag38_bounding_box", "SELECT l_returnflag, min(l_quantity) x0, max(l_quantity) x1, min(l_discount) y0, max(l_discount) y1 FROM lineitem GROUP BY 1")
def bounding_box(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_discount").alias("y0"), F.max("l_discount").alias("y1"))


@query("di01_distinct_on", """
    SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) k FROM orders) WHERE k = 1""")
def distinct_on(t: Tables) -> DataFrame:
    """The best order of each customer by priority rank, then date, then key."""
    rank = risk.lookup(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2}, 3)
    return aggregates.distinct_on(t.orders, ["o_custkey"], [rank, F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("di02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("di03_content_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


@query("di05_zone_key", "SELECT l_suppkey::VARCHAR || ':' || l_returnflag || ':' || (floor(l_extendedprice / 50) * 50)::BIGINT::VARCHAR AS dedup_key, max(l_quantity) AS score FROM lineitem GROUP BY 1")
def zone_key(t: Tables) -> DataFrame:
    """DI-05, DI-06: the strongest candidate of each 50 m zone."""
    return t.lineitem.groupBy(risk.dedup_key(F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_extendedprice")).alias("dedup_key")).agg(F.max("l_quantity").alias("score"))


@query("jn04_bracket_interp", """
    WITH e AS (SELECT user_id, epoch(ts) AS x, max(value) AS v FROM events GROUP BY ALL),
    p AS (SELECT user_id, min(x) + (max(x) - min(x)) * k / 8.0 - 50000 * (k = 0)::INT AS x, k FROM e, range(0, 10) r(k) GROUP BY user_id, k),
    b AS (SELECT p.user_id, p.k, p.x, max(e.x) FILTER (e.x <= p.x) x0, min(e.x) FILTER (e.x >= p.x) x1 FROM p JOIN e USING (user_id) GROUP BY ALL)
    SELECT b.user_id, b.k::INT AS k, round(CASE WHEN x0 IS NULL THEN e1.v WHEN x1 IS NULL THEN e0.v WHEN x0 = x1 THEN e0.v ELSE e0.v + (e1.v - e0.v) * (b.x - x0) / (x1 - x0) END, 4) AS v
    FROM b LEFT JOIN e e0 ON e0.user_id = b.user_id AND e0.x = x0 LEFT JOIN e e1 ON e1.user_id = b.user_id AND e1.x = x1""")
def bracket_interp(t: Tables) -> DataFrame:
    """Values between the neighbouring events, clamped outside of them."""
    e = t.events.groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).agg(F.max("value").alias("v")).select("user_id", (F.col("us") / 1e6).alias("x"), "v")
    p = e.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    p = p.select("user_id", "k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / 8.0 - F.when(F.col("k") == 0, 50000).otherwise(0)).alias("x"))
    return joins.bracket(p, e, ["user_id"], "x", ["v"]).select("user_id", "k", _r(F.col("interp_v"), 4).alias("v"))


def _asof(sign: str, pick: str) -> str:
    return f"""
    WITH e AS (SELECT user_id, ts, max(event_id) AS id FROM events WHERE event_type = 'error' GROUP BY ALL), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
    m AS (SELECT p.event_id, p.user_id, {pick}(e.ts) AS ts FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.ts {sign} p.ts GROUP BY ALL)
    SELECT event_id, e.id AS error_id FROM m LEFT JOIN e ON e.user_id = m.user_id AND e.ts = m.ts"""


def _probe(t: Tables, direction: str) -> DataFrame:
    e = t.events.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("id"))
    p = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.asof(p, e, ["user_id"], "ts", ["id"], direction).select("event_id", F.col("asof_id").alias("error_id"))


@query("jn02_asof_back", _asof("<=", "max"))
def asof_back(t: Tables) -> DataFrame:
    """Each purchase with its user's last error before it."""
    return _probe(t, "backward")


@query("jn03_asof_fwd", _asof(">=", "min"))
def asof_fwd(t: Tables) -> DataFrame:
    return _probe(t, "forward")


@query("jn05_nearest_value", """
    WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x FROM part), l AS (SELECT l_partkey, l_quantity AS x, min(l_orderkey) AS k FROM lineitem GROUP BY ALL)
    SELECT p_partkey, k AS order_key FROM (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(l.x - p.x), k) n FROM p LEFT JOIN l ON l_partkey = p_partkey) WHERE n = 1""")
def nearest_value(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"))
    l = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("x")).agg(F.min("l_orderkey").alias("k"))
    return joins.nearest(p, l, ["p_partkey"], "x", ["k"], "k").select("p_partkey", F.col("near_k").alias("order_key"))


_POINTS = "SELECT s_suppkey AS id, 20 + (s_suppkey * 37 % 997) / 100.0 AS lat, 90 + (s_suppkey * 101 % 991) / 100.0 AS lon FROM supplier"
_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ^ 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ^ 2)))"


@query("jn06_radius", f"WITH p AS ({_POINTS}) SELECT a.id, b.id AS other_id, round({_HAV}, 1) AS distance_m FROM p a JOIN p b ON a.id <> b.id WHERE {_HAV} <= 100000")
def radius(t: Tables) -> DataFrame:
    """Pairs of wells within 100 km, by grid cells."""
    k = F.col("s_suppkey")
    p = t.supplier.select(k.alias("id"), (20 + (k * 37 % 997) / 100.0).alias("lat"), (90 + (k * 101 % 991) / 100.0).alias("lon"))
    return joins.radius(p, p, 100_000.0).withColumn("distance_m", _r(F.col("distance_m"), 1))


@query("jn10_rrf", """
    WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) r FROM documents QUALIFY r <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY length(source) DESC, doc_id DESC) r FROM documents QUALIFY r <= 50)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 8) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def rrf(t: Tables) -> DataFrame:
    """Two top-50 rankings fused: each is cut before it is numbered."""

    def top(*order) -> DataFrame:
        best = t.documents.select("doc_id", "n_chars", "source").orderBy(*order).limit(50)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("doc_id", "rank")

    a, b = top(F.desc("n_chars"), F.col("doc_id")), top(F.length("source").desc(), F.desc("doc_id"))
    return joins.full_rank_fusion(a, b, "doc_id").select("doc_id", _r(F.col("rrf"), 8).alias("rrf"))


@query("jn12_band", """
    SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(floor(epoch(a.ts))::BIGINT - floor(epoch(b.ts))::BIGINT) <= 3600""")
def band(t: Tables) -> DataFrame:
    """Errors and purchases of one user within an hour."""
    e = t.events.select("user_id", "event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("a_id"), F.col("s").alias("sa"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("sb"))
    return joins.band(a, b, ["user_id"], "sa", "sb", 3600).select("a_id", "b_id")


@query("jn13_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_JN14_SQL = """
    WITH s AS (SELECT l_suppkey, l_linenumber * 1000.0 AS a, l_linenumber * 1000.0 + 900 + l_quantity * 10 AS b, min(l_orderkey) k FROM lineitem GROUP BY ALL),
    p AS (SELECT s_suppkey, (500.0 * g)::DOUBLE AS x FROM supplier, range(1, 15) r(g))
    SELECT s_suppkey, x, arg_min(k, (a, b, k)) AS section FROM p JOIN s ON l_suppkey = s_suppkey AND a <= x AND x < b GROUP BY ALL"""


@query("jn14_containment", _JN14_SQL)
def containment(t: Tables) -> DataFrame:
    return _containment(t, t.lineitem)


def _containment(t: Tables, lines: DataFrame) -> DataFrame:
    """The first section that holds a depth: points are zero-width intervals of an overlap join."""
    a = F.col("l_linenumber") * 1000.0
    s = lines.groupBy(F.col("l_suppkey").alias("k"), a.alias("r_from"), (a + 900 + F.col("l_quantity") * 10).alias("r_to")).agg(F.min("l_orderkey").alias("section"))
    p = t.supplier.select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(14))).alias("g")).withColumn("l_from", F.col("g") * 500.0).withColumn("l_to", F.col("l_from") + 1e-6)
    j = joins.overlap(p, s, ["k"], 1000.0).where("r_from <= l_from")
    return j.groupBy(F.col("k").alias("s_suppkey"), F.col("l_from").alias("x")).agg(F.min_by("section", F.struct("r_from", "r_to", "section")).alias("section"))


_JN16_SQL = """
    WITH i AS (SELECT o_custkey AS k, epoch(o_orderdate)::DOUBLE / 86400 AS a, epoch(o_orderdate)::DOUBLE / 86400 + 20 + o_orderkey % 30 AS b, o_totalprice AS p FROM orders),
    q AS (SELECT c_custkey AS k, (8000.0 + 200 * g)::DOUBLE AS a, (8100.0 + 200 * g)::DOUBLE AS b FROM customer, range(0, 12) r(g))
    SELECT q.k, q.a, max(p) AS top FROM q JOIN i ON i.k = q.k AND i.a < q.b AND i.b > q.a GROUP BY ALL"""


@query("jn16_overlap", _JN16_SQL)
def overlap(t: Tables) -> DataFrame:
    return _overlap(t, t.customer)


def _overlap(t: Tables, customer: DataFrame) -> DataFrame:
    """The largest order of those that overlap a window."""
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double") / 86400
    i = t.orders.select(F.col("o_custkey").alias("k"), day.alias("r_from"), (day + 20 + F.col("o_orderkey") % 30).alias("r_to"), F.col("o_totalprice").alias("p"))
    q = customer.select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("g"))
    q = q.select("k", (8000.0 + 200 * F.col("g")).alias("l_from"), (8100.0 + 200 * F.col("g")).alias("l_to"))
    return joins.overlap(q, i, ["k"], 100.0).groupBy("k", F.col("l_from").alias("a")).agg(F.max("p").alias("top"))


@query("jn21_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn26_latest_relation", "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def latest_relation(t: Tables) -> DataFrame:
    """JN-26, TK-07: every customer with its latest order."""
    last = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest")


@query("jn27_pool_others", """
    WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier) SELECT a.s_suppkey, count(b.s_suppkey)::BIGINT AS n, round(avg(b.s_acctbal), 5) AS pool FROM s a LEFT JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1""")
def pool_others(t: Tables) -> DataFrame:
    """Means over the other wells of a group: group sums less one's own, not a self-join."""
    w = Window.partitionBy("s_nationkey")
    n, total = F.count(F.lit(1)).over(w) - 1, F.sum("s_acctbal").over(w) - F.col("s_acctbal")
    return t.supplier.select("s_suppkey", n.alias("n"), _r(F.when(n > 0, total / F.nullif(n, F.lit(0))), 5).alias("pool"))


@query("pf02_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 100000")
def optional_filters(t: Tables) -> DataFrame:
    """Filters are added only for the arguments given."""
    args = {"priority": "2-HIGH", "status": None, "least": 100000.0}
    out = t.orders
    for name, test in (("priority", lambda v: F.col("o_orderpriority") == v), ("status", lambda v: F.col("o_orderstatus") == v), ("least", lambda v: F.col("o_totalprice") >= v)):
        if args[name] is not None:
            out = out.where(test(args[name]))
    return out.select("o_orderkey")


@query("pf03_open_interval", """
    WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS a, CASE WHEN l_linestatus = 'F' THEN l_quantity + 5 END AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM x WHERE (b IS NULL OR b >= 20) AND (a IS NULL OR a <= 30)""")
def open_interval(t: Tables) -> DataFrame:
    x = t.lineitem.withColumn("a", F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).withColumn("b", F.when(F.col("l_linestatus") == "F", F.col("l_quantity") + 5))
    return x.where((F.col("b").isNull() | (F.col("b") >= 20)) & (F.col("a").isNull() | (F.col("a") <= 30))).select("l_orderkey", "l_linenumber")


@query("pf06_list_filter", "SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012')) AND c_acctbal > 0")
def list_filter(t: Tables) -> DataFrame:
    q = "00012"
    return t.customer.where(F.lower("c_name").contains(q) | F.lower("c_mktsegment").contains(q)).where("c_acctbal > 0").select("c_custkey")


@query("pf11_case_filter", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 3 THEN l_tax * 100 END, l_quantity) AS d FROM lineitem WHERE coalesce(CASE WHEN l_linenumber > 3 THEN l_tax * 100 END, l_quantity) <= 5")
def case_filter(t: Tables) -> DataFrame:
    d = F.coalesce(F.when(F.col("l_linenumber") > 3, F.col("l_tax") * 100), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", d.alias("d")).where("d <= 5")


@query("pf12_null_safe", "SELECT a.s_suppkey, count(*)::BIGINT AS n FROM supplier a JOIN supplier b ON (CASE WHEN a.s_acctbal > 5000 THEN a.s_nationkey END) IS NOT DISTINCT FROM (CASE WHEN b.s_acctbal > 5000 THEN b.s_nationkey END) GROUP BY 1")
def null_safe(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).alias("k"))
    n = s.groupBy(F.col("k").alias("k2")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, F.col("k").eqNullSafe(F.col("k2"))).select("s_suppkey", "n")


@query("pf14_hidden_future", """
    WITH b AS (SELECT user_id, max(ts) - INTERVAL 30 DAY AS bit FROM events WHERE user_id % 3 = 0 GROUP BY 1)
    SELECT event_id FROM events e LEFT JOIN b USING (user_id) WHERE bit IS NULL OR ts <= bit""")
def hidden_future(t: Tables) -> DataFrame:
    """Rows beyond their well's bit are hidden; wells without a bit are shown whole."""
    b = t.events.where("user_id % 3 = 0").groupBy("user_id").agg((F.max("ts") - F.expr("interval 30 days")).alias("bit"))
    return t.events.join(b, "user_id", "left").where("bit is null or ts <= bit").select("event_id")


@query("pf16_json_fields", "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("pf17_typed_cast", "SELECT p_partkey, try_cast(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_size::VARCHAR END AS DOUBLE) AS v, try_cast(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_size::VARCHAR END AS DOUBLE) IS NULL AS rejected FROM part")
def typed_cast(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    v = raw.try_cast("double")
    return t.part.select("p_partkey", v.alias("v"), v.isNull().alias("rejected"))


@query("tk05_topk_nulls", "SELECT * FROM (SELECT p_partkey, nullif(p_size, 50) AS s FROM part) ORDER BY s DESC NULLS LAST, p_partkey LIMIT 25")
def topk_nulls(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(50)).alias("s")).orderBy(F.col("s").desc_nulls_last(), "p_partkey").limit(25)


@query("tk06_top_reasons", "SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:5]::VARCHAR AS reasons FROM orders GROUP BY 1")
def top_reasons(t: Tables) -> DataFrame:
    """The five weightiest of each group, cut before they are gathered."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = t.orders.withColumn("r", F.row_number().over(w)).where("r <= 5")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))), lambda x: x.o_orderkey.cast("string"))
    return top.groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("reasons"))


@query("tk12_shallowest", "SELECT p_brand, min(p_retailprice) AS top FROM part GROUP BY 1 ORDER BY 2, 1")
def shallowest(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("top")).orderBy("top", "p_brand")


@query("so02_candidate_union", """
    WITH u AS (SELECT l_suppkey AS k, l_quantity AS s, 0 AS o FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier WHERE s_acctbal > 0)
    SELECT k, arg_max(s, (o, s)) AS score FROM u GROUP BY 1""")
def candidate_union(t: Tables) -> DataFrame:
    """Two candidate lists; where keys collide the second wins, within a list the higher score."""
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("s"), F.lit(0).alias("o"))
    b = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("s"), F.lit(1).alias("o"))
    return a.unionByName(b).groupBy("k").agg(F.max_by("s", F.struct("o", "s")).alias("score"))


@query("so03_set_algebra", """
    WITH x AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
    SELECT o_custkey, len(list_intersect(p, ['1-URGENT', '2-HIGH', '9-NONE']))::INT AS both_, len(list_filter(p, lambda v: NOT list_contains(['1-URGENT', '2-HIGH'], v)))::INT AS extra, list_has_all(['O', 'F'], s) AS subset FROM x""")
def set_algebra(t: Tables) -> DataFrame:
    """SO-03 to SO-05: difference, subset, intersection of collected sets."""
    x = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    arr = lambda *v: F.array(*map(F.lit, v))
    return x.select("o_custkey", F.size(F.array_intersect("p", arr("1-URGENT", "2-HIGH", "9-NONE"))).alias("both_"), F.size(F.array_except("p", arr("1-URGENT", "2-HIGH"))).alias("extra"), (F.size(F.array_except("s", arr("O", "F"))) == 0).alias("subset"))


@query("so06_grid", "SELECT s_suppkey, k::INT AS k, floor(s_acctbal / 25) * 25 + 25 * k AS md_from, risk FROM supplier, range(0, 12) r(k), (VALUES ('losses'), ('kick'), ('torque')) v(risk)")
def grid(t: Tables) -> DataFrame:
    """SO-06 to SO-11: twelve cells ahead, anchored to multiples of 25, for each risk."""
    risks = t.spark.createDataFrame([("losses",), ("kick",), ("torque",)], "risk string")
    g = t.supplier.select("s_suppkey", (F.floor(F.col("s_acctbal") / risk.INTERVAL_M) * 25).cast("double").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    return g.select("s_suppkey", "k", (F.col("start") + 25 * F.col("k")).alias("md_from")).crossJoin(F.broadcast(risks))


@query("so07_short_last_cell", "SELECT p_partkey, a::DOUBLE AS md_from, least(a + 25, p_size)::DOUBLE AS md_to FROM part, range(0, 51, 25) r(a) WHERE a < p_size")
def short_last_cell(t: Tables) -> DataFrame:
    cells = t.part.where("p_size > 0").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") - 1, F.lit(25))).alias("a"))
    return cells.select("p_partkey", F.col("a").cast("double").alias("md_from"), F.least(F.col("a") + 25, F.col("p_size")).cast("double").alias("md_to"))


@query("ql01_rest_query", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 50000 AND NOT o_orderpriority LIKE '%LOW' AND o_custkey <> 7 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 5""")
def rest_query(t: Tables) -> DataFrame:
    """QL-01 to QL-09 in one request."""
    return restql.query(t.orders, {"o_orderstatus": "in.(O,P)", "o_totalprice": "gte.50000", "o_orderpriority": "not.like.*LOW", "o_custkey": "neq.7", "order": "o_totalprice.desc,o_orderkey.asc", "limit": "40", "offset": "5", "select": "o_orderkey,o_totalprice"})


@query("ql10_embedded", "SELECT c_custkey, n_name, coalesce(len(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), 0)::INT AS n_jobs FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def embedded(t: Tables) -> DataFrame:
    """A to-one struct and a to-many array beside each row."""
    jobs = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("jobs"))
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    full = j.select("c_custkey", F.struct("n_nationkey", "n_name").alias("wells"), F.coalesce("jobs", F.array()).alias("jobs"))
    return full.select("c_custkey", "wells.n_name", F.size("jobs").alias("n_jobs"))


@query("fn04_haversine", f"WITH p AS ({_POINTS}) SELECT a.id, round({_HAV}, 2) AS d FROM p a, (SELECT 25.0 AS lat, 95.0 AS lon) b")
def haversine(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), _r(geo.haversine_m(20 + (k * 37 % 997) / 100.0, 90 + (k * 101 % 991) / 100.0, F.lit(25.0), F.lit(95.0))).alias("d"))


@query("fn11_relative_depth", """
    WITH x AS (SELECT p_partkey, p_brand, p_retailprice AS top, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS nxt FROM part)
    SELECT p_partkey, round(CASE WHEN nxt > top THEN greatest(0.0, least(1.0, (top + 1 - top) / (nxt - top))) END, 6) AS rel FROM x""")
def relative_depth(t: Tables) -> DataFrame:
    """WN-13, FN-11: where a depth lies between its top and the next, null without a next one."""
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    x = t.part.select("p_partkey", F.col("p_retailprice").alias("top"), F.lead("p_retailprice").over(w).alias("nxt"))
    return x.select("p_partkey", _r(F.when(F.col("nxt") > F.col("top"), risk.clip01((F.col("top") + 1 - F.col("top")) / F.nullif(F.col("nxt") - F.col("top"), F.lit(0.0)))), 6).alias("rel"))


@query("fn15_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS even, (round_even(l_extendedprice / 5, 0) * 5)::DOUBLE AS fives FROM lineitem")
def half_even(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2).alias("even"), (F.bround(F.col("l_extendedprice") / 5) * 5).alias("fives"))


_VERDICT = "list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'date' END], lambda x: x IS NOT NULL)"


@query("fn51_verdict", f"""
    WITH x AS (SELECT l_orderkey, l_linenumber, len({_VERDICT}) AS n, l_returnflag FROM lineitem),
    y AS (SELECT *, greatest(0.05, 0.95 - 0.3 * n)::DOUBLE AS c FROM x), z AS (SELECT *, CASE WHEN n > 0 THEN least(c, 0.5) WHEN l_returnflag = 'N' THEN least(c, 0.8) ELSE c END AS d FROM y)
    SELECT l_orderkey, l_linenumber, n::INT AS n_failed, round(d, 4) AS confidence, CASE WHEN d >= 0.85 THEN 'auto_approved' ELSE 'pending' END AS status FROM z""")
def verdict(t: Tables) -> DataFrame:
    """Failed rules take 0.3 each, down to 0.05; a failure caps at 0.5, an unknown formation at 0.8."""
    rules = {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.08, "tax": F.col("l_tax") > 0.07, "date": F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")}
    n = F.size(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()))
    c = F.greatest(F.lit(0.05), 0.95 - 0.3 * n)
    d = F.when(n > 0, F.least(c, F.lit(0.5))).when(F.col("l_returnflag") == "N", F.least(c, F.lit(0.8))).otherwise(c)
    return t.lineitem.select("l_orderkey", "l_linenumber", n.alias("n_failed"), _r(d, 4).alias("confidence"), F.when(d >= 0.85, "auto_approved").otherwise("pending").alias("status"))


@query("fn52_confidence", "SELECT c_custkey, CASE WHEN n >= 3 AND coalesce(m, -1) >= 0.8 THEN 'high' WHEN n >= 2 OR coalesce(m, -1) >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM (SELECT c_custkey, c_custkey % 5 AS n, nullif(c_custkey % 10, 3) / 10.0 AS m FROM customer)")
def confidence(t: Tables) -> DataFrame:
    n, m = F.col("c_custkey") % 5, F.nullif(F.col("c_custkey") % 10, F.lit(3)) / 10.0
    return t.customer.select("c_custkey", risk.confidence(n, m).alias("level"))


@query("fn54_retrigger", """
    WITH x AS (SELECT o_orderkey, o_orderstatus = 'F' AS fired, o_totalprice / 5000 AS s, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 100)::DOUBLE END AS old FROM orders),
    b AS (SELECT *, CASE WHEN s <= 20 THEN 0 WHEN s <= 40 THEN 1 WHEN s <= 60 THEN 2 WHEN s <= 80 THEN 3 ELSE 4 END AS nb, CASE WHEN old IS NULL OR old <= 20 THEN 0 WHEN old <= 40 THEN 1 WHEN old <= 60 THEN 2 WHEN old <= 80 THEN 3 ELSE 4 END AS ob FROM x)
    SELECT o_orderkey, fired OR nb > ob OR s >= ob * 20 + 15 AS again FROM b""")
def retrigger(t: Tables) -> DataFrame:
    s, old = F.col("o_totalprice") / 5000, F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 100).cast("double"))
    return t.orders.select("o_orderkey", risk.retrigger(F.col("o_orderstatus") == "F", risk.band(s), s, old).alias("again"))


@query("x_cube", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("x_rollup", "SELECT r_name, n_name, count(*)::BIGINT AS n FROM nation JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("x_setops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def setops(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).exceptAll(t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")))


@query("ag29_most_common", "SELECT user_id, arg_min(event_type, {'n': -n, 'f': f}) AS kind FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY 1")
def most_common(t: Tables) -> DataFrame:
    """Each user's most frequent kind of event; ties go to the kind that was seen first."""
    return aggregates.most_common(t.events, ["user_id"], "event_type", "event_id", "kind")
