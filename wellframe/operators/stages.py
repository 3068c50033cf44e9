"""Lineage cut in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written by ``checkpoint()`` under ``spark.checkpoint.dir``; only where that is unset (tests), in a folder of our own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="wellframe-shared-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table to the same folder and read again: ``checkpoint()`` computes its rows twice."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{path.rstrip('/') if path else 'file://' + tempfile.mkdtemp(prefix='wellframe-shared-')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task gets to sort where partitions are dealt by their number.
TASK_ROWS = 250_000


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` of so many rows by keys in partitions of TASK_ROWS on average, no fewer than the session has: a task sorts no more as tables grow."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS)), *keys)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by keys in as many partitions as the session has: for steps that take far longer than the bytes of their rows say.

    A small table is one file that one task reads, and Spark merges small partitions; it leaves those that are asked for by number.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
