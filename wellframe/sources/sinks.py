"""Keyed writes for plain Parquet: a table is a folder of versions, the newest complete one counts.

A write makes a new version and moves the pointer last, so readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Table:
    """One table under ``path``; single writer."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(n.getName()[1:]) for n in names if n.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        cols = self.read().columns
        df.select(*cols).write.parquet(f"{self.path}/v{max(self._versions(), default=0) + 1}")

    def append(self, rows: DataFrame) -> None:
        self._write(self.read().unionByName(rows))

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """New rows replace old ones of the same key."""
        self._write(self.read().join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows))

    def insert_absent(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows whose key is there already are left out, as are repeated keys within ``rows``."""
        old = self.read()
        self._write(old.unionByName(rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")))

    def replace_parent(self, rows: DataFrame, parent: str) -> None:
        """All old rows of the parents in ``rows`` go."""
        self.upsert(rows, [parent])

    def purge(self, stale: Column) -> None:
        self._write(self.read().where(~F.coalesce(stale, F.lit(False))))

    def update(self, changes: dict[str, Column], where: Column) -> None:
        out = self.read()
        self._write(out.withColumns({c: F.when(F.coalesce(where, F.lit(False)), e).otherwise(F.col(c)) for c, e in changes.items()}))


def latest_per_key(keys: list[str], order: str, sink: Table) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key."""

    def run(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        sink.upsert(newest, keys)

    return run


def export_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, with a header."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
