"""Depth- and time-ordered operators: a well is a user, its series the user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import risk
from wellframe.operators import windows
from wellframe.plans.registry import Tables, query

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "event_type", "value", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))


def _w() -> Window:
    return windows.series(["user_id"], ["ts", "event_id"])


def _r(col, digits: int = 4):
    return F.round(col, digits)


@query("wn03_cumsum", f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS run FROM events")
def cumsum(t: Tables) -> DataFrame:
    return t.events.select("event_id", _r(F.sum("value").over(_w().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("run"))


@query("wn04_trailing", """
    WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, value FROM events)
    SELECT a.event_id, count(b.value)::BIGINT AS n, round(CASE WHEN count(b.value) >= 3 THEN avg(b.value) END, 6) AS mean,
           round(CASE WHEN count(b.value) >= 3 THEN coalesce(regr_slope(b.value, (b.s - a.s)::DOUBLE), 0) * 432000 END, 3) AS slope
    FROM e a JOIN e b ON a.user_id = b.user_id AND b.s > a.s - 432000 AND b.s <= a.s GROUP BY 1""")
def trailing(t: Tables) -> DataFrame:
    """WN-04, WN-05: mean and slope over a trailing range that is open on the left."""
    e = _events(t)
    out = windows.trailing(e, ["user_id"], "s", "value", 432000)
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-431999, 0)
    return out.select("event_id", F.count("value").over(w).alias("n"), _r(F.col("mean"), 6).alias("mean"), _r(F.col("slope"), 3).alias("slope"))


@query("wn06_last_known", f"SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def last_known(t: Tables) -> DataFrame:
    v = F.when(F.col("event_type") == "error", F.col("value"))
    return t.events.select("event_id", F.last(v, ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("v"))


_Z = "CASE WHEN event_type <> 'view' THEN value END"


@query("wn07_zscore", f"""
    WITH x AS (SELECT event_id, {_Z} AS v, avg({_Z}) OVER w AS m, stddev_pop({_Z}) OVER w AS d, count({_Z}) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(CASE WHEN n >= 20 AND v IS NOT NULL THEN (v - m) / greatest(d, 0.01 * abs(m), 1e-6) END, 4) AS z FROM x""")
def zscore(t: Tables) -> DataFrame:
    v = F.when(F.col("event_type") != "view", F.col("value"))
    return t.events.select("event_id", _r(windows.zscore(v, _w())).alias("z"))


@query("wn08_runs", f"""
    WITH x AS (SELECT *, value > 20 AS ok, floor(epoch(ts))::BIGINT AS s FROM events), y AS (SELECT *, CASE WHEN ok AND NOT coalesce(lag(ok) OVER w, false) THEN 1 ELSE 0 END AS b FROM x {_W}),
    z AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM y)
    SELECT event_id, CASE WHEN ok THEN i END::BIGINT AS island, CASE WHEN ok THEN s - min(s) OVER (PARTITION BY user_id, CASE WHEN ok THEN i END ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS held FROM z""")
def runs(t: Tables) -> DataFrame:
    """WN-08, WN-17: for how long a condition has held."""
    out = windows.run_lengths(_events(t), ["user_id"], ["ts", "event_id"], F.col("value") > 20, "s")
    return out.select("event_id", "island", F.col("held").cast("long").alias("held"))


@query("wn09_drawdown", """
    SELECT event_id, round(max(value) OVER w - value, 4) AS fall, round(value - min(value) OVER w, 4) AS gain FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)""")
def drawdown(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-600000, 0)
    return _events(t).select("event_id", _r(F.max("value").over(w) - F.col("value")).alias("fall"), _r(F.col("value") - F.min("value").over(w)).alias("gain"))


@query("wn10_two_windows", """
    SELECT event_id, round(avg(value) OVER a, 10) AS recent, round(avg(value) OVER b, 10) AS trend FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)
    WINDOW a AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 500000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 2500000 PRECEDING AND 500001 PRECEDING)""")
def two_windows(t: Tables) -> DataFrame:
    """The recent stretch against the longer one before it; the border belongs to the recent one."""
    w = Window.partitionBy("user_id").orderBy("s")
    return _events(t).select("event_id", _r(F.avg("value").over(w.rangeBetween(-500000, 0)), 10).alias("recent"), _r(F.avg("value").over(w.rangeBetween(-2500000, -500001)), 10).alias("trend"))


@query("wn11_recent_drop", f"""
    WITH x AS (SELECT event_id, list_filter(list({_Z}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), lambda q: q IS NOT NULL) AS h FROM events)
    SELECT event_id, round(CASE WHEN len(h) > 5 THEN 1 - list_avg(h[-5:]) / nullif(list_avg(h[:-6]), 0) END, 4) AS drop_ FROM x""")
def recent_drop(t: Tables) -> DataFrame:
    """The last five known values against the ones before, of the last 60 rows."""
    v = F.when(F.col("event_type") != "view", F.col("value"))
    h = F.collect_list(v).over(_w().rowsBetween(-59, 0))
    x = t.events.select("event_id", h.alias("h"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.nullif(F.size(a), F.lit(0))
    base = mean(F.slice("h", F.lit(1), F.greatest(F.size("h") - 5, F.lit(0))))
    return x.select("event_id", _r(F.when(F.size("h") > 5, 1 - mean(F.slice("h", F.greatest(F.size("h") - 4, F.lit(1)), F.lit(5))) / F.nullif(base, F.lit(0.0)))).alias("drop_"))


@query("wn12_episodes", f"""
    WITH x AS (SELECT *, event_type IN ('view', 'click') AS off_ FROM events), y AS (SELECT *, CASE WHEN off_ AND NOT coalesce(lag(off_) OVER w, false) THEN 1 ELSE 0 END b FROM x {_W}),
    z AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) i FROM y)
    SELECT user_id, i::BIGINT AS episode, count(*)::BIGINT AS n, max(value) AS peak, min(event_id) AS first_id FROM z WHERE off_ GROUP BY ALL""")
def episodes(t: Tables) -> DataFrame:
    """Sessions in which a condition holds, with their peak."""
    out = windows.run_lengths(_events(t), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click"), "s").where("island is not null")
    return out.groupBy("user_id", F.col("island").alias("episode")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.min("event_id").alias("first_id"))


@query("wn14_order_repair", """
    WITH x AS (SELECT p_partkey, p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
    SELECT p_partkey, round(5 * k + max(v - 5 * k) OVER (PARTITION BY p_brand ORDER BY k ROWS UNBOUNDED PRECEDING), 3) AS fixed, round(5 * k + max(v - 5 * k) OVER (PARTITION BY p_brand ORDER BY k ROWS UNBOUNDED PRECEDING) - v, 3) AS raised FROM x""")
def order_repair(t: Tables) -> DataFrame:
    out = windows.repaired(t.part, ["p_brand"], ["p_partkey"], "p_retailprice")
    return out.select("p_partkey", _r(F.col("fixed"), 3).alias("fixed"), _r(F.col("raised"), 3).alias("raised"))


@query("wn15_out_of_order", "SELECT p_partkey, coalesce(p_size < max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS flagged FROM part")
def out_of_order(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.part.select("p_partkey", F.coalesce(F.col("p_size") < F.max("p_size").over(w), F.lit(False)).alias("flagged"))


@query("wn16_derived_time", f"""
    WITH x AS (SELECT *, CASE WHEN value >= 0.5 THEN least(3600.0, abs(value - lag(value) OVER w) / value * 3600) ELSE 5 END AS d FROM events {_W})
    SELECT event_id, round(sum(coalesce(d, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS t FROM x""")
def derived_time(t: Tables) -> DataFrame:
    """Times summed from depth steps over the rate, at most an hour each, five seconds without a rate."""
    step = F.when(F.col("value") >= 0.5, F.least(F.lit(3600.0), F.abs(F.col("value") - F.lag("value").over(_w())) / F.col("value") * 3600)).otherwise(5.0)
    x = t.events.select("user_id", "ts", "event_id", F.coalesce(step, F.lit(0.0)).alias("d"))
    return x.select("event_id", _r(F.sum("d").over(_w().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("t"))


@query("wn18_first_fire", "SELECT user_id, event_type, min(floor(epoch(ts))::BIGINT) AS first_s FROM events WHERE value > 30 GROUP BY ALL")
def first_fire(t: Tables) -> DataFrame:
    return _events(t).where("value > 30").groupBy("user_id", "event_type").agg(F.min("s").alias("first_s"))


@query("tk11_downsample", """
    WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    b AS (SELECT *, (i - 1) // greatest(1, ceil(n / 20.0)::BIGINT) AS b FROM x)
    SELECT user_id, arg_max(event_id, (value, -i)) AS event_id FROM b GROUP BY user_id, b""")
def downsample(t: Tables) -> DataFrame:
    """At most 20 rows of each series, each the peak of its bucket."""
    e = t.events.select("user_id", "event_id", "ts", "value")
    return windows.downsampled(e, ["user_id"], ["ts", "event_id"], "value", 20).select("user_id", "event_id")


@query("wn20_ranking", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranking(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("q"))


@query("pf19_notify", f"""
    SELECT event_id, value > 20 AND coalesce(lag(value) OVER w, 0) <= 20 AS notify FROM events {_W}""")
def notify(t: Tables) -> DataFrame:
    """Whether a row's newer version crosses the threshold that the one before it hadn't."""
    return t.events.select("event_id", ((F.col("value") > 20) & (F.coalesce(F.lag("value").over(_w()), F.lit(0.0)) <= 20)).alias("notify"))


@query("st14_health", """
    WITH l AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS last_s FROM events GROUP BY 1), n AS (SELECT max(floor(epoch(ts))::BIGINT) AS now_s FROM events)
    SELECT user_id, (now_s - last_s)::BIGINT AS age, CASE WHEN now_s - last_s > 30 * 3600 THEN 'lost' WHEN now_s - last_s > 10 * 3600 THEN 'stale' ELSE 'live' END AS status FROM l, n""")
def health(t: Tables) -> DataFrame:
    """Stream status by the age of the last sample, thresholds strict; an hour here is a second there."""
    e = _events(t)
    last = e.groupBy("user_id").agg(F.max("s").alias("last_s"))
    now = e.agg(F.max("s").alias("now_s"))
    age = F.col("now_s") - F.col("last_s")
    return last.crossJoin(F.broadcast(now)).select("user_id", age.alias("age"), F.when(age > risk.LOST_S * 3600, "lost").when(age > risk.STALE_S * 3600, "stale").otherwise("live").alias("status"))


@query("st15_escalation", """
    WITH n AS (SELECT max(o_orderdate) AS now_ FROM orders)
    SELECT o_orderkey FROM orders, n WHERE o_orderstatus = 'O' AND ((o_orderpriority = '2-HIGH' AND floor(epoch(now_))::BIGINT - floor(epoch(o_orderdate))::BIGINT > 900 * 86400) OR (o_orderpriority = '1-URGENT' AND floor(epoch(now_))::BIGINT - floor(epoch(o_orderdate))::BIGINT > 300 * 86400))""")
def escalation(t: Tables) -> DataFrame:
    """Unacknowledged warnings and criticals past their limits; a day here is a second there."""
    o = t.orders.withColumn("s", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    limit = risk.lookup(F.col("o_orderpriority"), {"2-HIGH": risk.ESCALATE_S["warning"] * 86400, "1-URGENT": risk.ESCALATE_S["critical"] * 86400})
    now = o.agg(F.max("s").alias("now_s"))
    return o.where("o_orderstatus = 'O'").crossJoin(F.broadcast(now)).where(F.col("now_s") - F.col("s") > limit).select("o_orderkey")


@query("st16_auto_resolve", """
    WITH b AS (SELECT user_id, max(value) AS bit, count(*) % 5 = 0 AS lost FROM events GROUP BY 1)
    SELECT e.event_id FROM events e JOIN b USING (user_id) WHERE NOT lost AND bit > value + 25 AND event_type <> 'error'""")
def auto_resolve(t: Tables) -> DataFrame:
    """Alerts whose zone the bit has passed by more than 25 m, unless the stream is lost."""
    b = t.events.groupBy("user_id").agg(F.max("value").alias("bit"), (F.count(F.lit(1)) % 5 == 0).alias("lost"))
    return t.events.join(b, "user_id").where(~F.col("lost") & (F.col("bit") > F.col("value") + risk.PAST_ZONE_M) & (F.col("event_type") != "error")).select("event_id")


@query("x_session_window", f"""
    WITH x AS (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 86400 AS g FROM events), y AS (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) i FROM x)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*)::BIGINT AS n FROM y GROUP BY user_id, i""")
def session_window(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("w.start").alias("start_s"), "n")


@query("x_tumbling_window", "SELECT event_type, (floor(epoch(ts))::BIGINT // 86400) * 86400 AS day_s, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling_window(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_seconds("w.start").alias("day_s"), "n")
