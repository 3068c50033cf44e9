"""Reports on predictions against ground truth: extracted events, formation tops, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.operators import joins, matching
from wellframe.operators.stages import cut

#: What an event of another type but the same risk counts (fixed value).
SAME_RISK = 0.5


def matched_events(predicted: DataFrame, truth: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """page, a, b, gap, score of the one-to-one matching of each page's events (page, id, event_type, risk, md).

    Equal types first, score 1, then what is free of equal risk, score SAME_RISK; the smaller gap first in both.
    """
    types = matching.nearest(predicted, truth, ["page", "event_type"], "md", "id", tolerance).select("page", "a", "b", "gap", F.lit(1.0).alias("score"))
    rest = lambda df, end: df.where("risk is not null").join(types.select("page", F.col(end).alias("id")), ["page", "id"], "left_anti")
    risks = matching.nearest(rest(predicted, "a"), rest(truth, "b"), ["page", "risk"], "md", "id", tolerance)
    return types.unionByName(risks.select("page", "a", "b", "gap", F.lit(SAME_RISK).alias("score")))


def matched_tops(predicted: DataFrame, truth: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """page, a, b: each true top (page, id, formation, md), in order of its id, takes the first free prediction of its name within the tolerance."""
    name = lambda df, id_, md: df.select("page", F.lower(F.trim("formation")).alias("name"), F.col("id").alias(id_), F.col("md").alias(md))
    near = joins.band(name(truth, "b", "mb"), name(predicted, "a", "ma"), ["page", "name"], "mb", "ma", tolerance)
    near = near.withColumns({"_a": F.struct("page", "a"), "_b": F.struct("page", "b")})
    return matching.edges(near.select("page", "a", "b", "_a", "_b"), "_a", "_b", ["b"]).select("page", "a", "b")


def scores(found: Column, predicted: Column, truth: Column) -> list[Column]:
    """precision, recall, f1; null where they are not defined."""
    p, r = found / F.nullif(predicted, F.lit(0)), found / F.nullif(truth, F.lit(0))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]


def extraction_report(predicted: DataFrame, truth: DataFrame, pages: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """doc_type ("all" for all together), found, predicted, truth, precision, recall, f1; pages: page, doc_type."""
    found = matched_events(predicted, truth, tolerance).groupBy("page").agg(F.sum("score").alias("found"))
    count = lambda df, n: df.groupBy("page").agg(F.count("*").alias(n))
    each = pages.join(found, "page", "left").join(count(predicted, "predicted"), "page", "left").join(count(truth, "truth"), "page", "left").na.fill(0)
    sums = [F.sum(c).alias(c) for c in ("found", "predicted", "truth")]
    out = each.rollup("doc_type").agg(*sums, F.grouping("doc_type").alias("g")).withColumn("doc_type", F.when(F.col("g") == 1, "all").otherwise(F.col("doc_type").cast("string")))
    return out.select("doc_type", "found", "predicted", "truth", *scores(F.col("found"), F.col("predicted"), F.col("truth")))


def alert_scores(truth: DataFrame, alerts: DataFrame, wells: DataFrame, cell: float = 250.0) -> DataFrame:
    """well, events, hits, lead_m (array), alerts, false_alerts, drilled_m for each well.

    truth: well, event, risk, md_from, md_to; alerts: well, alert, risk, zone_from, zone_to, bit; wells: well, start, td.  An event
    below the start is hit by an alert of its risk whose zone overlaps it, raised above it; the lead is that of the shallowest bit.
    An alert is false if its zone overlaps no event of its risk.
    """
    t = truth.select("well", "risk", "event", F.col("md_from").alias("l_from"), F.col("md_to").alias("l_to"))
    z = alerts.select("well", "risk", "alert", "bit", F.col("zone_from").alias("r_from"), F.col("zone_to").alias("r_to"))
    met = cut(joins.overlap(t, z, ["well", "risk"], cell, closed=True).select("well", "event", "alert", "bit", "l_from"))
    early = met.where("bit < l_from").groupBy("well", "event").agg((F.first("l_from") - F.min("bit")).alias("lead"))
    future = truth.join(wells.select("well", "start"), "well").where("md_from > start").select("well", "event")
    by_event = future.join(early, ["well", "event"], "left").groupBy("well").agg(F.count("*").alias("events"), F.count("lead").alias("hits"), F.array_sort(F.collect_list("lead")).alias("lead_m"))
    false = alerts.select("well", "alert").join(met.select("well", "alert").distinct().withColumn("hit", F.lit(1)), ["well", "alert"], "left")
    by_alert = false.groupBy("well").agg(F.count("*").alias("alerts"), F.sum(F.col("hit").isNull().cast("long")).alias("false_alerts"))
    out = wells.select("well", F.greatest(F.lit(0.0), F.col("td") - F.col("start")).alias("drilled_m")).join(by_event, "well", "left").join(by_alert, "well", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("events", "hits", "alerts", "false_alerts")]
    return out.select("well", *zero, F.coalesce("lead_m", F.array().cast("array<double>")).alias("lead_m"), "drilled_m")


def alert_report(per_well: DataFrame) -> DataFrame:
    """One row: wells, events, hits, hit_rate, median_lead_m, alerts, false_alerts, false_per_1000m."""
    leads = per_well.select(F.explode("lead_m").alias("l")).agg(F.median("l").alias("median_lead_m"))
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("events", "hits", "alerts", "false_alerts")]
    total = per_well.agg(F.count("*").alias("wells"), *sums, F.sum("drilled_m").alias("drilled"))
    rate = (F.col("hits") / F.nullif("events", F.lit(0))).alias("hit_rate")
    return total.crossJoin(leads).select("wells", "events", "hits", rate, "median_lead_m", "alerts", "false_alerts", (F.col("false_alerts") * 1000 / F.nullif("drilled", F.lit(0.0))).alias("false_per_1000m"))  # one row each
