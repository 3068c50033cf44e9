"""Similarity of names and snippets: the share of characters in a longest common subsequence, as Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    """200 x common subsequence / summed lengths, by bit-parallel dynamic programming."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


class Snippet:
    """A short text that is looked for in longer ones, with a bit mask of the places of each of its characters."""

    def __init__(self, text: str):
        self.size, self.full, self.where = len(text), (1 << len(text)) - 1, {}
        for i, c in enumerate(text):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def common(self, text: str) -> Iterator[int]:
        """The length of the longest common subsequence with each prefix of ``text``, from the first character on."""
        row, get = self.full, self.where.get
        for c in text:
            u = row & get(c, 0)
            row = ((row + u) | (row - u)) & self.full
            yield self.size - row.bit_count()

    def length(self, text: str) -> int:
        row, get, full = self.full, self.where.get, self.full
        for c in text:
            u = row & get(c, 0)
            if u:
                row = ((row + u) | (row - u)) & full
        return self.size - row.bit_count()


#: Texts that are searched side by side: their characters together, and the 64-bit words of their snippets.
MANY, WORDS = 1 << 20, 4


def _windows(m: int, n: int) -> list[tuple[int, int]]:
    """The first and last beginning of stretches of ``m`` characters that are looked at together, some m of them."""
    return [(lo, min(lo + m, n - m)) for lo in range(0, n - m + 1, m + 1)]


def _common(pairs: list[tuple[str, str]]) -> list[list[int]]:
    """``Snippet.length`` in each of ``_windows`` of (snippet, text), for snippets of as many words: all windows take their next character at once."""
    words = -(-max(len(s) for s, _ in pairs) // 64)
    masks, starts, sizes, full, counts, base = [], [], [], [], [], 0
    for short, long in pairs:
        of = Snippet(short)
        codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros((max(map(ord, of.where)) + 2, words), np.uint64)
        split = lambda bits: [bits >> 64 * w & 2**64 - 1 for w in range(words)]
        for c, bits in of.where.items():
            table[ord(c)] = split(bits)
        masks.append(table[np.minimum(codes, len(table) - 1)])
        spans = _windows(of.size, len(long))
        starts += [base + lo for lo, _ in spans]
        sizes += [hi - lo + of.size for lo, hi in spans]
        full += [split(of.full)] * len(spans)
        counts.append(len(spans))
        base += len(long)
    at, size = np.array(starts), np.array(sizes)
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    mask = [np.ascontiguousarray(w) for w in np.concatenate(masks).T]
    whole = np.array(full, np.uint64)[order].T
    row = [w.copy() for w in whole]
    going = np.searchsorted(-size, -np.arange(size[0]))  # windows that go on: they are sorted by size
    for step, k in enumerate(going.tolist()):
        here, carry = at[:k] + step, None
        for w in range(words):
            r = row[w][:k]
            u = r & mask[w][here]
            up = r + u
            over = up < r
            if carry is not None:
                up += carry
                over |= up < carry
            row[w][:k] = up | (r - u)
            carry = over.astype(np.uint64)
    left = sum(np.bitwise_count(r & f).astype(np.int64) for r, f in zip(row, whole, strict=True))
    have = sum(np.bitwise_count(f).astype(np.int64) for f in whole)
    out = np.empty(len(order), np.int64)
    out[order] = have - left
    return [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])]


def partial_ratios(a: list[str | None], b: list[str | None], least: float = 0.0) -> list[float]:
    """``partial_ratio`` of each pair, 0 where one is null; the first look at all stretches is that of many texts at a time."""
    out, groups = [0.0] * len(a), {}

    def flush(words: int) -> None:
        todo, _ = groups.pop(words)
        for (n, short, long), common in zip(todo, _common([p[1:] for p in todo]), strict=True):
            out[n] = partial_ratio(short, long, least, common)

    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        words = -(-len(short) // 64)
        if not short or words > WORDS or len(long) > MANY or short in long:
            out[n] = partial_ratio(short, long, least)
            continue
        todo, chars = groups.get(words, ([], 0))
        todo.append((n, short, long))
        groups[words] = todo, chars + len(long)
        if chars + len(long) > MANY:
            flush(words)
    for words in list(groups):
        flush(words)
    return out


def partial_ratio(short: str, long: str, least: float = 0.0, common: list[int] | None = None) -> float:
    """The best ``ratio`` of the shorter text with a stretch of the longer one: as long as it is, or shorter at either end.

    0 if it is below ``least``.  Stretches are searched by halves: what one has in common with the snippet, all that lie inside it
    cannot exceed.  ``common``: what the first stretches have in common with the snippet, if it is known.
    """
    if len(short) > len(long):
        short, long = long, short
    m, n = len(short), len(long)
    if not m:
        return 100.0 if not n and least <= 100 else 0.0
    if short in long:
        return 100.0
    s, best = Snippet(short), max(0.0, least - 1e-9)
    hit = False
    ends = [(long[: m - 1], s)] + [(long[: -m if m < n else None : -1][: m - 1], Snippet(short[::-1]))]
    for text, by in ends:  # shorter stretches at the start, and at the end read backwards
        for k, c in enumerate(by.common(text), 1):
            if 200.0 * c / (m + k) > best:
                best, hit = 200.0 * c / (m + k), True
    # Stretches of m characters that begin in [lo, hi], some m at a time.
    first = _windows(m, n)
    todo = [(lo, hi, c) for (lo, hi), c in zip(first, common or [None] * len(first), strict=True)][::-1]
    while todo:
        lo, hi, c = todo.pop()
        c = s.length(long[lo : hi + m]) if c is None else c
        if 100.0 * c / m <= best:
            continue
        if lo == hi:
            best, hit = 100.0 * c / m, True
        else:
            mid = (lo + hi) // 2
            todo += [(mid + 1, hi, None), (lo, mid, None)]
    if len(short) == n:  # of equal lengths either one is the shorter
        for text, by in ((short[: n - 1], Snippet(long)), (short[:0:-1], Snippet(long[::-1]))):
            for k, c in enumerate(by.common(text), 1):
                if 200.0 * c / (n + k) > best:
                    best, hit = 200.0 * c / (n + k), True
    return best if hit else 0.0


def squash(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def snippet_ratio(snippet: Column, text: Column, least: float) -> Column:
    """``partial_ratio`` of squashed texts if it is ``least`` or more, else 0; exact containment doesn't leave the JVM's result.

    Null if either is null; a blank snippet is in no text.
    """

    def some(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(partial_ratios(list(a), list(b), least), dtype=float)

    a, b = squash(snippet), squash(text)
    open_ = (a != "") & ~F.contains(b, a)
    fuzzy = F.pandas_udf(some, DoubleType())(F.when(open_, a), F.when(open_, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == "", 0.0).when(F.contains(b, a), 100.0).otherwise(fuzzy)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


#: Letters of the grams of names.
Q = 2


def resolve(names: DataFrame, name: str, known: DataFrame, alias: str, target: str, least: float = 90.0) -> DataFrame:
    """``names`` with ``target``: an exact alias, else the one most similar alias of ``least`` or more; a tie is no match.

    Of two names that similar, of n and m letters with e = (1 - least / 100) * (n + m) letters outside the common ones, at most
    2 e of the n - 1 grams of one are not in the other.  So with the grams in order, rare ones first, they share one of the first
    2 e + 1 of each; candidates meet there, and the commonest grams join nothing.  Names too short for that meet by length.
    """
    n = names.select(squash(F.col(name)).alias("_n")).where("_n is not null").distinct()
    k = known.select(squash(F.col(alias)).alias("_a"), F.col(target).alias("_t")).where("_a is not null").distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - Q + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(Q))))
    often = k.select(F.explode(grams(F.col("_a"))).alias("_g")).groupBy("_g").agg(F.count("*").alias("_o"))
    # The other name has length / least * (200 - least) letters at most.
    spare = lambda c: (F.floor((1 - least / 100) * (F.length(c) + F.length(c) * (200 - least) / least) + 1e-9) * Q + 1).cast("int")

    def first(df: DataFrame, c: str) -> DataFrame:
        by = Window.partitionBy(c).orderBy(F.coalesce("_o", F.lit(0)), "_g")
        flat = df.select(c).distinct().withColumn("_g", F.explode(grams(F.col(c)))).join(often, "_g", "left")
        flat = flat.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= spare(F.col(c))).select(c, "_g")
        short = df.select(c).distinct().where(spare(F.col(c)) >= F.length(c) - Q + 1)  # may share no gram at all
        near = F.explode(F.sequence(F.length(c) - 2, F.length(c) + 2)) if c == "_n" else F.length(c)
        return flat.unionByName(short.select(c, F.concat(F.lit("length "), near.cast("string")).alias("_g") if c == "_a" else near.alias("_l")).selectExpr(c, "_g" if c == "_a" else "concat('length ', _l) as _g"))

    met = first(n, "_n").join(first(k, "_a"), "_g").select("_n", "_a").distinct()
    fuzzy = F.pandas_udf(_ratios, DoubleType())("_n", "_a")
    near = met.where("_n <> _a").withColumn("_s", fuzzy).where(F.col("_s") >= least).unionByName(n.join(k.select("_a").distinct(), F.col("_n") == F.col("_a")).withColumn("_s", F.lit(101.0)))
    best = near.join(k, "_a").groupBy("_n", "_t").agg(F.max("_s").alias("_s"))
    top = best.groupBy("_n").agg(F.max("_s").alias("_m"))
    best = best.join(top, "_n").where("_s = _m").groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), F.first("_t").alias(target)).where("_c = 1")
    return names.withColumn("_n", squash(F.col(name))).join(best.select("_n", target), "_n", "left").drop("_n")
