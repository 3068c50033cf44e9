"""Aggregations with tie rules, weights and leave-one-out, all from built-in aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The most frequent non-null value of each key, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(out))


def most_common(df: DataFrame, keys: list[str], value: str, seen: str, out: str) -> DataFrame:
    """The most frequent non-null value of each key; of equally frequent ones that which ``seen`` (an order) has first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"), F.col(value))).alias(out))


def weighted_prediction(df: DataFrame, keys: list[str], value: str, distance: str, least: int = 2, near: float = 100.0) -> DataFrame:
    """Inverse-distance mean, weighted spread, leave-one-out error and uncertainty of each key with ``least`` rows."""
    w = 1 / F.pow(F.greatest(F.col(distance), F.lit(near)), 2)
    rows = df.where(F.col(value).isNotNull() & F.col(distance).isNotNull()).withColumn("_w", w).withColumn("_wv", F.col("_w") * F.col(value))
    all_ = Window.partitionBy(*keys)
    rows = rows.withColumns({"_sw": F.sum("_w").over(all_), "_swv": F.sum("_wv").over(all_), "_n": F.count(F.lit(1)).over(all_)}).where(F.col("_n") >= least)
    rows = rows.withColumn("_p", F.col("_swv") / F.col("_sw")).withColumn("_e", F.col(value) - (F.col("_swv") - F.col("_wv")) / F.nullif(F.col("_sw") - F.col("_w"), F.lit(0.0)))
    spread = F.sqrt(F.sum(F.col("_w") * F.pow(F.col(value) - F.col("_p"), 2)) / F.sum("_w"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("_p").alias("predicted"), spread.alias("spread"), F.sqrt(F.avg(F.pow("_e", F.lit(2)))).alias("loo_rmse"))
    return out.withColumn("uncertainty", F.greatest(F.lit(10.0), F.sqrt(F.pow("spread", F.lit(2)) + F.pow("loo_rmse", F.lit(2)))))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; taken before rows move, as Spark limits the group on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the precision-recall curve by steps, rows of one score taken together."""
    by = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("_tp", F.sum("tp").over(w)).withColumn("_n", F.sum("n").over(w))
    return by.groupBy(*keys).agg((F.sum(F.col("tp") * F.col("_tp") / F.col("_n")) / F.nullif(F.sum("tp"), F.lit(0))).alias("average_precision"))


def capped_list(df: DataFrame, keys: list[str], order: list[Column], text: str, most: int, budget: int) -> DataFrame:
    """Of each key the first ``most`` texts in order, as far as their summed length is within ``budget``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    rows = rows.withColumn("_c", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_c") <= budget)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]).alias("texts"))


def smoothed_rate(hits: Column, weights: Column, prior_hit: float = 0.5, prior_weight: float = 1.0) -> Column:
    """(sum of hit weights + prior) / (sum of weights + prior); null without weight."""
    return F.when(F.sum(weights) > 0, (F.sum(hits) + prior_hit) / (F.sum(weights) + prior_weight))
