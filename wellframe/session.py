"""One place where sessions get their settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that queries rely on; sizes are left to the cluster.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "wellframe", master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC time, ANSI SQL and adaptive execution."""
    b = SparkSession.builder.appName(name).config(map=BASE | (extra or {}))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
