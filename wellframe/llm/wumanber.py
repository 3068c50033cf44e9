"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of ``window`` consecutive words of a benchmark item (an item of fewer words is
one window).  Windows of one length share tables: a shift table by the hash of a block of two words says
how far the search may jump without missing an occurrence; where the shift is zero, the block's bucket of
suffix and prefix hashes selects the windows that can end there, and their bytes are compared.

Many lanes of a batch are searched in step, so the jumps are array operations.  A benchmark is broadcast in
blocks of at most ``MAX_BLOCK_WORDS`` words; a larger one costs further passes over the same rows, one after
the other and without a shuffle, with the rows written in between: a task or executor holds one block at a time.

Edge cases: null or empty texts, or texts without words, have no words and no hits, as document or item.  An
item with a null id marks words but is not listed; items that share an id count once.  Repeated rows are
judged one by one.  An empty benchmark hits nothing; an empty document table gives no rows.  ``scan`` reads
and returns only the columns it names; ``keep_clean`` returns all columns as they are.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import checkpointed, discard, free_memory, small_batches, staged
from wellframe.llm.words import Words, blocks, mix

#: A broadcast block has so many words at most (some 60 MB of tables), or one item.
MAX_BLOCK_WORDS = 500_000
SHIFT_BITS = 18
LANES = 1024


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Tables:
    """Shift and bucket tables of the windows of one length."""

    length: int
    shift: np.ndarray
    #: sorted suffix-and-prefix hashes, and the window at each
    bucket: np.ndarray
    window: np.ndarray
    #: distinct windows: their bytes, and which items they belong to
    texts: list[bytes]
    items: list[list[str | None]]


@dataclass
class Patterns:
    tables: list[Tables] = field(default_factory=list)


def build(items: list[tuple[str | None, str | None]], window: int = 10) -> Patterns:
    """Tables of some items' windows."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for lo, hi, w in blocks(pa.array([t for _, t in items], pa.string())):
        h = w.hashes() if len(w) else np.zeros(0, np.uint64)
        for i in range(lo, hi):
            a, b = int(w.first[i - lo]), int(w.first[i - lo + 1])
            m = min(window, b - a)
            for k in range(a, b - m + 1) if m else ():
                entry = by_length.setdefault(m, {}).setdefault(w.joined(k, k + m), (h[k : k + m], set()))
                entry[1].add(items[i][0])
    out = Patterns()
    for m, found in sorted(by_length.items()):
        texts = list(found)
        hashes = np.stack([found[t][0] for t in texts])
        shift = np.full(1 << SHIFT_BITS, max(1, m - 1), dtype=np.uint8)
        for q in range(min(1, m - 1), m):  # blocks that end at word q
            key = _slot(hashes[:, q - 1] if m > 1 else hashes[:, q], hashes[:, q])
            np.minimum.at(shift, key, np.uint8(m - 1 - q))
        keys = _bucket_key(hashes[:, max(0, m - 2)], hashes[:, m - 1], hashes[:, 0], hashes[:, min(1, m - 1)])
        order = np.argsort(keys, kind="stable")
        items_of = [sorted(found[t][1], key=lambda x: (x is None, x)) for t in texts]
        out.tables.append(Tables(m, shift, keys[order], order, texts, items_of))
    return out


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_block_hash(a, b) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


def _bucket_key(s0: np.ndarray, s1: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return mix(_block_hash(s0, s1)) + _block_hash(p0, p1)


def search(w: Words, h: np.ndarray, t: Tables) -> Iterator[tuple[int, int]]:
    """(first word, window) of every occurrence in the words of ``w``, within one text each."""
    n, m = len(h), t.length
    if n < m:
        return
    step = max(m, -(-(n - m + 1) // LANES))
    pos = np.arange(m - 1, n, step)
    end = np.minimum(pos + step, n)
    ends = []
    back = 1 if m > 1 else 0
    while len(pos):
        jump = t.shift[_slot(h[pos - back], h[pos])]
        zero = jump == 0
        ends.append(pos[zero])
        pos = pos + np.maximum(jump, 1)
        stay = pos < end
        pos, end = pos[stay], end[stay]
    at = np.sort(np.concatenate(ends)) - (m - 1)
    if not len(at):
        return
    key = _bucket_key(h[at + max(0, m - 2)], h[at + m - 1], h[at], h[at + min(1, m - 1)])
    lo, hi = np.searchsorted(t.bucket, key, "left"), np.searchsorted(t.bucket, key, "right")
    text = np.searchsorted(w.first, at, "right")
    some = (hi > lo) & (w.first[text] >= at + m)  # a window within one text
    for a, l, r in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
        here = w.joined(a, a + m)
        for k in range(l, r):
            if t.texts[t.window[k]] == here:
                yield a, int(t.window[k])


def hits(texts: pa.Array, patterns: Patterns) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """For each text its number of words, the maximal runs [first, after last) of hit words, and the items found."""
    for lo, hi, w in blocks(texts):
        h = w.hashes() if len(w) else np.zeros(0, np.uint64)
        runs: dict[int, list[list[int]]] = {}
        items: dict[int, set] = {}
        for t in patterns.tables:
            for a, k in search(w, h, t):
                i = int(np.searchsorted(w.first, a, "right")) - 1
                a -= int(w.first[i])
                runs.setdefault(i, []).append([a, a + t.length])
                items.setdefault(i, set()).update(t.items[k])
        for i in range(hi - lo):
            yield int(w.first[i + 1] - w.first[i]), merged(runs.get(i, [])), items.get(i, set())


def merged(runs: list) -> list[tuple[int, int]]:
    """The union of intervals, as disjoint intervals in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def load(benchmark: DataFrame, item: str, text: str, window: int = 10, max_words: int = MAX_BLOCK_WORDS) -> list[Broadcast]:
    """The benchmark's tables, built in tasks and broadcast in blocks of bounded size.

    Items are dealt to groups by hash, four fifths of a block each on average, however many partitions there are; a group
    with more than a block makes several.  The driver sees finished blocks only, a file split at a time, and keeps none.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    words = F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2) + 1)  # at most
    groups = math.ceil(1.25 * (rows.agg(words).first()[0] or 1) / max_words)

    def run(group: pa.Table) -> pa.Table:
        blocks_, part, size = [], [], 0
        for i, t in zip(group.column("item").to_pylist(), group.column("text").to_pylist(), strict=True):
            n = len(t or "") // 2 + 1
            if part and size + n > max_words:
                blocks_.append(pickle.dumps(build(part, window)))
                part, size = [], 0
            part.append((i, t))
            size += n
        return pa.table({"block": pa.array([*blocks_, pickle.dumps(build(part, window))], pa.binary())})

    dealt = rows.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(groups)).alias("group"))
    built = staged(dealt.applyInArrow(run, "block binary"), "benchmark")
    out = [spark.sparkContext.broadcast(pickle.loads(r.block)) for r in built.toLocalIterator()]
    discard(built)
    return out or [spark.sparkContext.broadcast(Patterns())]


def in_turn(docs: DataFrame, patterns: list[Broadcast], step: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """``docs`` after a pass of ``step`` for each block; all but the last are written, so that tasks hold one block at a time."""
    last = len(patterns) - 1
    for i, p in enumerate(patterns):
        before, docs = docs, step(docs, p, i == last)
        if i < last:
            docs = checkpointed(docs)
            discard(before)
            p.unpersist()
    return docs


def scan(docs: DataFrame, key: str, text: str, patterns: list[Broadcast]) -> DataFrame:
    """key, n_words, n_hit (longs), items (array of ids), spans (array of first word, word after the last)."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, kind = to_arrow_type(docs.schema[key].dataType), docs.schema[key].dataType.simpleString()
    span_type = pa.list_(pa.list_(pa.int64()))
    names = ["key", "text", "n_words", "items", "spans"]

    def one(pattern: Broadcast, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1)
                old = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if b.num_columns > 2 else itertools.repeat(([], []))
                n, items, spans = [], [], []
                for (words, runs, found), (had, before) in zip(hits(texts, pattern.value), old, strict=False):
                    n.append(words)
                    spans.append([list(x) for x in (merged([*runs, *map(tuple, before)]) if before else runs)])
                    items.append(sorted({x for x in found if x is not None} | set(had)))
                yield pa.record_batch([b.column(0), pa.nulls(b.num_rows, pa.string()) if last else texts, pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type)], names)

        return run

    schema = f"key {kind}, text string, n_words bigint, items array<string>, spans array<array<bigint>>"
    out = in_turn(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), patterns, lambda df, p, last: df.mapInArrow(one(p, last), schema))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), "items", "spans")


def keep_clean(docs: DataFrame, text: str, patterns: list[Broadcast]) -> DataFrame:
    """The rows of ``docs`` without a hit word, in all their columns."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text), docs.schema

    def step(df: DataFrame, p: Broadcast, _: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not runs for _, runs, _ in hits(b.column(at), p.value)], pa.bool_()))
            free_memory()

        return df.mapInArrow(run, schema)

    return in_turn(docs.select("*"), patterns, step)
