"""Tables cut out of the lineage, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="wellframe-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder name under the shared one that nobody has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor then costs no recomputation.

    A written table rather than ``checkpoint()``: it is columnar, so later reads prune columns.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder partition by partition, so that its rows keep their places; for ``discard`` as well."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint()
    out.staged_path = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other DataFrames are left as they are."""
    for t in tables:
        if path := getattr(t, "staged_path", None):
            delete(t.sparkSession, path)


#: Rows of an Arrow batch.  Rows here hold whole texts, so that Spark's usual ten thousand would take many megabytes
#: several times over, in the JVM and in each Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, unless it is lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(BATCH_ROWS))


def free_memory() -> None:
    """Give a finished task's memory back to the system: the Python worker stays for later tasks, idle or not."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bits that keys are hashed to.  They make 8 MB, in pieces of 32,768 bits.
MAP_BITS = 1 << 26


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose key is among ``keys``, of which there are few, and a few others.

    A bit map of fixed size is broadcast, so that most wide rows which nobody asks for are not moved; a join has to follow.
    """
    at = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    bits = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    bits = staged(bits, "bits")
    byte = F.conv(F.hex(F.substring("_bits", (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.bitmap_bit_position(at) % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("_piece")).where(hit).drop("_piece", "_bits")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose key is among ``keys``, of which there are few."""
    # A semi join would be pushed below the join with the map, and so move all rows.
    return likely(rows, keys, key).join(keys.select(key).distinct(), key).select(*rows.columns)
