"""Row-level changes of a table: captured between snapshots, filtered as subscribers ask, folded into a keyed view.

A change is an event with an operation (insert, update, delete), a sequence number, the row after it and the row before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: A subscriber's filter: column, operator, value.
FILTER = re.compile(r"(\w+)=(eq|neq|in|gte|gt|lte|lt)\.(.*)", re.DOTALL)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op, old, new (structs of all columns) of the rows that differ between two snapshots with unique keys.

    Rows with a null in a key are a row like any other; a column that one snapshot lacks is null there.  One join on the
    keys; equal rows leave before anything else moves.
    """
    names = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    kinds = {**{f.name: f.dataType for f in new.schema}, **{f.name: f.dataType for f in old.schema}}
    whole = lambda df: F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], whole(df).alias(name))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    both = side(old, "old").join(side(new, "new"), on, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(*[F.when(F.col("new").isNull(), F.col(f"old_{k}")).otherwise(F.col(f"new_{k}")).alias(k) for k in keys], op.alias("op"), "old", "new")


def wanted(row: Column, schema: StructType, text: str | None) -> Column:
    """Whether a row (a struct) passes a filter ``column=op.value``; a null or unknown column never does.

    eq, neq and in.(a,b) compare as text, gt, gte, lt and lte as numbers.  Without a filter, or with one of another form,
    nothing is held back.
    """
    asked = FILTER.fullmatch(text or "")
    if asked is None:
        return F.lit(True)
    name, op, value = asked.groups()
    if name not in schema.names:
        return F.lit(False)
    actual = row[name].cast("string")
    if op == "in":
        inner = value[1:-1] if value.startswith("(") and value.endswith(")") else value
        ok = actual.isin([v.strip().strip('"') for v in inner.split(",") if v.strip()] or [None])
    elif op in ("eq", "neq"):
        ok = actual == value if op == "eq" else actual != value
    else:
        a, b = actual.try_cast("double"), F.lit(value).try_cast("double")
        ok = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
    return F.coalesce(ok, F.lit(False))


def subscribed(feed: DataFrame, text: str | None) -> DataFrame:
    """The changes whose row passes: the new one, of a deletion the old one."""
    return feed.where(wanted(F.coalesce("new", "old"), feed.schema["new"].dataType, text))


def latest(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The view after all changes (keys, seq, op, new): each key's row of the largest seq, without those deleted."""
    last = feed.groupBy(*keys).agg(F.max_by(F.struct("seq", "op", "new"), "seq").alias("_l"))
    return last.select(*keys, "_l.seq", "_l.new").where(F.col("_l.op") != "delete")


class _Latest(StatefulProcessor):
    """Keeps each key's largest sequence number; later changes than that are passed on, others are repeats or out of order."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq bigint", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        seq = self.seen.get()[0] if self.seen.exists() else None
        best = None
        for b in rows:
            b = b if seq is None else b[b["seq"] > seq]
            if len(b):
                best = b.loc[[b["seq"].idxmax()]]
                seq = int(best["seq"].iloc[0])
        if best is not None:
            self.seen.update((seq,))
            yield best

    def close(self) -> None:
        pass


def view(feed: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """A stream of upserts by key from a stream of changes (keys, seq, and other columns): each batch's last change of each key.

    The state of a key is one number, so a restart goes on where it ended; with ``ttl_ms`` keys are forgotten after so long without
    a change.  Needs the RocksDB state store.  A table keyed by ``keys`` that takes every row, deletions as such, is the view.
    """
    return feed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Latest(ttl_ms), outputStructType=feed.schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")
