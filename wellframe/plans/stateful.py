"""Stateful and sequential operators on the driver's tables: detectors, the alert fold, near-duplicate events, a stream run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.operators import commands, dedup
from wellframe.plans.registry import Tables, query
from wellframe.streaming import alerts, detectors


def channels(t: Tables) -> DataFrame:
    """A channel stream derived from the events: one wellbore for each user, half a metre and five seconds a sample."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t.events.select("user_id", "event_id", "value", "event_type", n.alias("n"))
    v = F.col("value")
    return e.select(
        F.col("user_id").cast("string").alias("wellbore_id"), (1000 + 0.5 * F.col("n")).alias("md_m"), (30.0 * F.col("n")).alias("t"), F.when(F.col("event_type") == "error", 3.0).otherwise(12.0).alias("rop_m_h"), F.lit(2000.0).alias("flow_in_lpm"),
        (2000.0 - F.when(v > 20, 300.0).otherwise(0.0)).alias("flow_out_lpm"), (40 + v % 3 / 2).alias("pit_vol_m3"), F.lit(1500.0).alias("hookload_kn"), (15 + F.when(v > 100, v).otherwise(v / 100)).alias("torque_knm"), F.lit(1.2).alias("dxc"), F.lit(0.5).alias("gas_total_pct")
    )


@query("st03_detectors", """
    WITH c AS (SELECT user_id::VARCHAR AS w, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    x AS (SELECT *, v > 20 AS low, 15 + CASE WHEN v > 100 THEN v ELSE v / 100 END AS q, 40 + v % 3 / 2 AS pit FROM c),
    r AS (SELECT *, max(CASE WHEN NOT low THEN n ELSE 0 END) OVER (PARTITION BY w ORDER BY n) AS bad,
          max(pit) OVER (PARTITION BY w ORDER BY n ROWS 20 PRECEDING) - pit AS fall, avg(q) OVER z AS m, stddev_pop(q) OVER z AS sd, count(*) OVER z AS k FROM x WINDOW z AS (PARTITION BY w ORDER BY n ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    SELECT w AS wellbore_id, count(*) FILTER ((low AND n - bad - 1 >= 4) OR fall >= 1)::BIGINT AS losses, count(*) FILTER (k >= 20 AND (q - m) / greatest(sd, 0.01 * abs(m), 1e-6) > 3.5)::BIGINT AS torque FROM r GROUP BY 1""")
def detector_counts(t: Tables) -> DataFrame:
    """ST-03 to ST-10: how often the loss and torque rules fire on each wellbore."""
    r = detectors.detect_batch(channels(t))
    fired = lambda n: F.count_if(F.col("fired") & (F.col("detector") == n))
    return r.groupBy("wellbore_id").agg(fired("losses").alias("losses"), fired("torque_spike").alias("torque"))


@query("st17_alert_fold", """
    WITH RECURSIVE c AS (SELECT o_custkey::VARCHAR AS k, o_orderkey AS seq, o_totalprice / 5000 AS s, o_orderkey % 5 = 0 AS res, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice > 100000),
    b AS (SELECT *, CASE WHEN s <= 40 THEN 1 WHEN s <= 60 THEN 2 WHEN s <= 80 THEN 3 ELSE 4 END AS r FROM c),
    f AS (SELECT k, seq, n, CASE WHEN res THEN 'none' ELSE 'created' END AS action, CASE WHEN res THEN NULL ELSE r END AS sev, CASE WHEN res THEN NULL ELSE s END AS score, NOT res AS open_ FROM b WHERE n = 1
      UNION ALL SELECT b.k, b.seq, b.n,
        CASE WHEN res THEN CASE WHEN f.sev IS NULL THEN 'none' ELSE 'resolved' END WHEN f.open_ THEN CASE WHEN b.r > f.sev THEN 'renotified' ELSE 'updated' END
             WHEN f.sev IS NOT NULL AND b.r <= q AND b.s < q * 20 + 15 THEN 'suppressed' ELSE 'created' END,
        CASE WHEN res THEN f.sev WHEN f.open_ THEN greatest(b.r, f.sev) WHEN f.sev IS NOT NULL AND b.r <= q AND b.s < q * 20 + 15 THEN f.sev ELSE b.r END,
        CASE WHEN res THEN f.score WHEN f.open_ THEN b.s WHEN f.sev IS NOT NULL AND b.r <= q AND b.s < q * 20 + 15 THEN f.score ELSE b.s END,
        CASE WHEN res THEN false WHEN f.open_ THEN true ELSE NOT (f.sev IS NOT NULL AND b.r <= q AND b.s < q * 20 + 15) END
      FROM (SELECT *, CASE WHEN score <= 20 THEN 0 WHEN score <= 40 THEN 1 WHEN score <= 60 THEN 2 WHEN score <= 80 THEN 3 ELSE 4 END AS q FROM f) f JOIN b ON b.k = f.k AND b.n = f.n + 1)
    SELECT k AS dedup_key, seq, action, CASE sev WHEN 1 THEN 'info' WHEN 2 THEN 'watch' WHEN 3 THEN 'warning' WHEN 4 THEN 'critical' END AS severity, round(score, 6) AS score FROM f""")
def alert_fold(t: Tables) -> DataFrame:
    """ST-17, ST-18: created, re-notified, updated, suppressed or resolved, in order."""
    from wellframe.functions import risk

    s = F.col("o_totalprice") / 5000
    c = t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").cast("string").alias("dedup_key"), F.col("o_orderkey").alias("seq"), risk.band(s).alias("band"), s.alias("score"), F.lit(False).alias("fired"), (F.col("o_orderkey") % 5 == 0).alias("resolve"))
    c = c.withColumn("severity", risk.severity(F.col("band")))
    return alerts.fold_batch(c).withColumn("score", F.round("score", 6))


@query("di04_first_kept")
def first_kept(t: Tables) -> DataFrame:
    """No SQL: the recursion is too slow over the whole table; compared with brute force in the tests."""
    return _first_kept(t.lineitem)


def _first_kept(lines: DataFrame) -> DataFrame:
    """Near-duplicates within five units of an earlier kept row of the same key go."""
    rows = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    return dedup.first_kept(rows, ["l_suppkey", "l_returnflag"], "l_quantity", ["l_orderkey", "l_linenumber"], 5.0).select("l_orderkey", "l_linenumber")


@query("cm02_commands", """
    WITH x AS (SELECT o_orderkey AS alert_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' WHEN '3-MEDIUM' THEN 'watch' ELSE 'info' END AS sev, CASE o_orderkey % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'viewed' WHEN 2 THEN 'acknowledged' ELSE 'resolved' END AS state,
        CASE o_orderkey % 3 WHEN 0 THEN 'ack' WHEN 1 THEN 'resolve' ELSE 'dismiss' END AS action, CASE WHEN o_custkey % 2 = 0 THEN 'rig_engineer' ELSE 'rtoc_engineer' END AS role FROM orders)
    SELECT alert_id, action, CASE WHEN action = 'ack' AND state IN ('sent', 'viewed') THEN 'ok' WHEN action = 'dismiss' AND sev IN ('info', 'watch') AND state IN ('sent', 'viewed') THEN 'ok'
        WHEN action = 'resolve' AND sev IN ('info', 'watch') AND state IN ('sent', 'viewed', 'acknowledged') THEN 'ok' WHEN action = 'resolve' AND sev IN ('warning', 'critical') AND role <> 'rig_engineer' AND state = 'acknowledged' THEN 'ok' ELSE 'bad_state' END AS result FROM x""")
def command_log(t: Tables) -> DataFrame:
    """CM-02 to CM-04, CM-11: commands joined with the table of allowed transitions."""
    from wellframe.functions import risk

    k = F.col("o_orderkey")
    sev = risk.lookup(F.col("o_orderpriority"), {"1-URGENT": "critical", "2-HIGH": "warning", "3-MEDIUM": "watch"}, "info")
    a = t.orders.select(k.alias("alert_id"), F.col("o_custkey").cast("string").alias("wellbore_id"), sev.alias("severity"), risk.lookup(k % 4, {0: "sent", 1: "viewed", 2: "acknowledged"}, "resolved").alias("state"))
    c = t.orders.select(k.alias("alert_id"), risk.lookup(k % 3, {0: "ack", 1: "resolve"}, "dismiss").alias("action"), F.when(F.col("o_custkey") % 2 == 0, "rig_engineer").otherwise("rtoc_engineer").alias("role"), F.array(F.col("o_custkey").cast("string")).alias("assigned"), F.lit("long enough").alias("reason"))
    return commands.apply_commands(a, c).select("alert_id", "action", "result")


@query("cm06_review_cascade", """
    SELECT o_custkey AS parent_id, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'rejected' WHEN bool_or(o_orderstatus = 'P') THEN 'pending' ELSE 'approved' END AS status, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS n_pending FROM orders GROUP BY 1""")
def review(t: Tables) -> DataFrame:
    from wellframe.functions import risk

    return commands.review_cascade(t.orders.select(F.col("o_custkey").alias("parent_id"), risk.lookup(F.col("o_orderstatus"), {"F": "rejected", "P": "pending"}, "approved").alias("status")))


@query("cm07_moved_tops", """
    WITH m AS (SELECT o_orderkey AS doc, o_custkey % 10 AS dest FROM orders WHERE o_orderstatus = 'F'),
    t AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_partkey AS part, coalesce(dest, l_suppkey % 10) AS w, l_partkey % 50 AS f, l_returnflag AS s, coalesce(dest <> l_suppkey % 10, false) AS comes FROM lineitem LEFT JOIN m ON doc = l_orderkey),
    k AS (SELECT w, f, s, count(*) FILTER (NOT comes) AS stay, count(*) FILTER (comes) AS come FROM t GROUP BY ALL)
    SELECT w AS wellbore_id, f AS formation, s AS source, (stay + CASE WHEN stay = 0 AND come > 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM k WHERE stay + come > 0""")
def moved_tops(t: Tables) -> DataFrame:
    """CM-07: lines as tops of their orders, finished orders given a well by edit; how many tops each place has then."""
    from wellframe.operators import assignment

    none = F.lit(None).cast("string")
    k = F.col("o_orderkey")
    choices = t.orders.where("o_orderstatus = 'F'").select(k.alias("seq"), k.alias("field_id"), k.alias("doc_id"), F.lit("edit").alias("action"), none.alias("old_value"), F.concat(F.lit('{"value": "'), (F.col("o_custkey") % 10).cast("string"), F.lit('"}')).alias("new_value"))
    wells = t.spark.range(10).select(F.col("id").cast("string").alias("well_id"))
    bores = wells.select("well_id", F.col("well_id").cast("long").alias("wellbore_id"), F.lit("A").alias("name"), F.lit(True).alias("is_primary"))
    to = assignment.moves(assignment.decided(choices, wells, bores))
    tops = t.lineitem.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 10).alias("wellbore_id"), (F.col("l_partkey") % 50).alias("formation"), F.col("l_returnflag").alias("source"))
    return assignment.moved_tops(tops, to).groupBy("wellbore_id", "formation", "source").agg(F.count("*").alias("n"))
