"""Text of pages: recognised boxes in reading order, and windows of whole pages or log lines for a reader with a limit.

Both are running rules over ordered rows.  Reading order is islands of boxes that touch the line before; windows are packed
by one pass over sorted rows, which holds one window at a time, so a document of any length will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a window (fixed value).
WINDOW = 12_000
# How a time-log line and a report's head begin.
TIME_LINE = r"^(?:\d{2}:\d{2}|--:--)–(?:\d{2}:\d{2}|--:--) \|"
REPORT_HEAD = r"^Daily drilling report: well (.*?), wellbore .*?, date (\S+)"


def _folded(df: DataFrame, kind: str, out: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]], order: list) -> DataFrame:
    """Rows (key, ...) sorted within their key and handed as one stream to ``fold``, whose rows (key, ...) come back as they are made."""
    schema = f"key {kind}, {out}"
    names = ["key", *[x.strip().split(" ")[0] for x in out.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.column(0).type]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        ready: list[tuple] = []
        size = 0
        for r in fold(rows()):
            ready.append(r)
            size += len(r[-1])
            if size > 1 << 20:
                yield _batch(ready, types[0], names)
                ready, size = [], 0
        if ready:
            yield _batch(ready, types[0], names)

    return df.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    key, number, text = zip(*rows, strict=True)
    return pa.record_batch([pa.array(key, kind), pa.array(number, pa.int64()), pa.array(text, pa.string())], names)


def reading_order(boxes: DataFrame, page: str) -> DataFrame:
    """page, line (from 0), text: boxes (page, text, x, y, w, h) of one line joined left to right, lines from top to bottom.

    From the top by its middle, a box begins a line unless its middle is nearer to that of the line's first box than half the
    larger height of the two.  Ties go by x, then by text; null texts are empty.
    """
    at = F.col("y").cast("double") + F.col("h").cast("double") / 2
    rows = boxes.select(F.col(page).alias("key"), at.alias("at"), F.col("h").cast("double").alias("h"), F.col("x").cast("double").alias("x"), F.coalesce("text", F.lit("")).alias("text"))

    def fold(stream: Iterator[tuple]) -> Iterator[tuple]:
        now, line, number, first = object(), [], 0, None

        def joined() -> tuple:
            return now, number, " ".join(t for _, t in sorted(line))

        for key, middle, height, x, text in stream:
            same = key == now
            if line and not (same and abs(middle - first[0]) < 0.5 * max(height, first[1])):
                yield joined()
                number, line = number + 1, []
            if not same:
                now, number = key, 0
            if not line:
                first = middle, height
            line.append((x, text))
        if line:
            yield joined()

    kind = boxes.schema[page].dataType.simpleString()
    return _folded(rows, kind, "line bigint, text string", fold, ["at", "x", "text"]).withColumnRenamed("key", page)


def _packed(stream: Iterator[tuple[object, str, bool]], gap: str, limit: int) -> Iterator[tuple]:
    """Next-fit windows of (key, block, may begin one): a block that doesn't fit begins a window, if it may."""
    now, blocks, size, number = object(), [], 0, 0
    for key, block, may in stream:
        if key != now:
            if blocks:
                yield now, number, gap.join(blocks)
            now, blocks, size, number = key, [], 0, 0
        elif blocks and may and size + len(block) + len(gap) > limit:
            yield now, number, gap.join(blocks)
            blocks, size, number = [], 0, number + 1
        blocks.append(block)
        size += len(block) + len(gap)
    if blocks:
        yield now, number, gap.join(blocks)


def page_windows(pages: DataFrame, doc: str, page: str, text: str, limit: int = WINDOW) -> DataFrame:
    """doc, window (from 0), text: whole pages under their numbers, as many as fit; a longer page is alone, blank pages are left out."""
    bare = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    rows = pages.select(F.col(doc).alias("key"), F.col(page).alias("page"), bare.alias("text")).where("text <> ''")

    def fold(stream: Iterator[tuple]) -> Iterator[tuple]:
        return _packed(((key, f"=== PAGE {n} ===\n{t}", True) for key, n, t in stream), "\n\n", limit)

    return _folded(rows, pages.schema[doc].dataType.simpleString(), "window bigint, text string", fold, ["page", "text"]).withColumnRenamed("key", doc)


def log_windows(pages: DataFrame, doc: str, page: str, text: str, limit: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Time-log lines of rendered reports under their dates: (doc, window, text) and (doc, well_name: that of the last head, else "unknown").

    A date never begins a window, and a window of dates alone is none.
    """
    lines = pages.select(F.col(doc).alias("key"), F.col(page).alias("page"), F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    head = lambda i: F.regexp_extract("line", REPORT_HEAD, i)
    lines = lines.select("key", "page", "at", "line", head(1).alias("well"), head(2).alias("date"))
    lines = lines.where((F.col("date") != "") | F.col("line").rlike(TIME_LINE))
    block = F.when(F.col("date") != "", F.concat(F.lit("=== REPORT DATE "), F.col("date"), F.lit(" ==="))).otherwise(F.concat(F.lit("["), F.col("page").cast("string"), F.lit("] "), F.col("line")))
    rows = lines.select("key", "page", "at", block.alias("block"), (F.col("date") == "").alias("may"))

    def fold(stream: Iterator[tuple]) -> Iterator[tuple]:
        for key, number, window in _packed(((key, b, may) for key, _, _, b, may in stream), "\n", limit):
            if any(not x.startswith("===") for x in window.split("\n")):
                yield key, number, window

    kind = pages.schema[doc].dataType.simpleString()
    windows = _folded(rows, kind, "window bigint, text string", fold, ["page", "at"]).withColumnRenamed("key", doc)
    named = lines.where("date <> '' and well <> '?'").groupBy("key").agg(F.max_by("well", F.struct("page", "at")).alias("well_name"))
    names = pages.select(F.col(doc).alias("key")).distinct().join(named, "key", "left").select(F.col("key").alias(doc), F.coalesce("well_name", F.lit("unknown")).alias("well_name"))
    return windows, names
