"""Shards cut as runs of a Hilbert curve over several metadata dimensions.

Each dimension is quantised by its quantiles over all rows, strings by the rank of the whole value among all values, rows are ordered by the curve's index, and the
order is cut into runs of equal length.  A run is a compact region of every dimension, so a filter on any of
them skips most files by their minima and maxima.

The global rank needs no single task: rows are range-partitioned by (index, key), numbered within their
partition as they stand, and moved on by the partitions' row counts, of which there is one for each
partition.  A hot value of one dimension is spread by the others and by the key.

Edge cases: a null in a dimension has the lowest cell; a null text has size 1 and the checksum of no bytes;
rows that are equal in all columns get different slots; an empty table gives no rows.  Columns that are not
named are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellframe.llm.hilbert import hilbert_index
from wellframe.llm.staging import discard, staged


def hilbert_keys(df: DataFrame, dims: list[str], bits: int, keep: list[Column]) -> DataFrame:
    """``keep`` and ``curve``, the Hilbert index of the quantised ``dims``: numbers as they are, strings by their rank."""
    rows = staged(df.select(*keep, *(F.col(d).alias(f"_d{i}") for i, d in enumerate(dims))), "dims")
    names = [f.name for f in rows.schema if not f.name.startswith("_d")]
    used = [rows]
    for i, d in enumerate(dims):
        if isinstance(df.schema[d].dataType, T.StringType):
            values = staged(rows.select(F.col(f"_d{i}").alias("_v")).where("_v is not null").distinct(), "values")
            order = ranked(values, ["_v"])[0].select(F.col("_v").alias(f"_d{i}"), F.col("rank").cast("double").alias("_rank"))
            rows = rows.join(order, f"_d{i}", "left").drop(f"_d{i}").withColumnRenamed("_rank", f"_d{i}")
            used.append(values)
    rows = staged(rows.select(*names, *(F.col(f"_d{i}").cast("double").alias(f"_d{i}") for i in range(len(dims)))), "dims")
    discard(*used)
    at = [i / (2**bits - 1) for i in range(1, 2**bits - 1)]
    cuts = rows.agg(*(F.percentile_approx(f"_d{i}", at, 10_000).alias(f"_d{i}") for i in range(len(dims)))).first()
    edges = [np.unique(np.array(c or [], dtype=float)) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros((b.num_rows, len(edges)), dtype=np.uint64)
            for i, e in enumerate(edges):
                v = b.column(f"_d{i}").to_numpy(zero_copy_only=False).astype(float)
                cells[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "right"))
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(hilbert_index(np.minimum(cells, 2**bits - 1), bits))], [*names, "curve"])

    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("curve", T.LongType())])
    return rows.mapInArrow(run, schema)


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` (from 0, gapless, in the order of ``order``) and its number of rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = staged(dealt, "ranked")
    part = F.shiftright("_id", 33)
    counts = {r[0]: r[1] for r in dealt.groupBy(part.alias("p")).count().collect()}  # one for each partition
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = spark.createDataFrame(starts or [(0, 0)], "p bigint, start bigint")
    out = dealt.join(F.broadcast(offsets), part == F.col("p"))  # as many rows as partitions
    return out.withColumn("rank", F.col("start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "p", "start"), total


def shard(df: DataFrame, key: str, text: str, dims: list[str], shards: int = 16, bits: int = 5) -> DataFrame:
    """key, size, text_crc32, curve, shard, slot: runs of the curve, whose row counts differ by one at most."""
    payload = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(key).alias("key"), (F.octet_length(payload) + F.lit(1)).cast("bigint").alias("size"), F.crc32(payload.cast("binary")).alias("text_crc32")]
    keyed = hilbert_keys(df, dims, bits, keep)
    rows, n = ranked(staged(keyed, "curve"), ["curve", "key", "size", "text_crc32"])
    rows = rows.withColumn("shard", F.expr(f"cast(((rank + 1) * {shards} - 1) div {max(n, 1)} as int)"))
    rows = rows.withColumn("slot", F.col("rank") - F.expr(f"(cast(shard as bigint) * {n}) div {shards}"))
    return rows.select(F.col("key").alias(key), "size", "text_crc32", "curve", "shard", "slot")


def pruning_table(df: DataFrame, shard_col: str, dims: list[str]) -> DataFrame:
    """For each shard its rows and the minimum and maximum of every dimension: what a reader prunes by."""
    stats = [f for d in dims for f in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))]
    return df.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"), *stats)


def prune(table: DataFrame, **bounds: tuple) -> DataFrame:
    """The shards whose ranges meet every given (low, high)."""
    tests = [(F.col(f"{d}_max") >= lo) & (F.col(f"{d}_min") <= hi) for d, (lo, hi) in bounds.items()]
    return table.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def write_shards(df: DataFrame, shard_col: str, order: list[str], path: str) -> None:
    """One folder for each shard, rows in slot order, so that row groups prune too."""
    df.repartition(F.col(shard_col)).sortWithinPartitions(shard_col, *order).write.partitionBy(shard_col).parquet(path)
