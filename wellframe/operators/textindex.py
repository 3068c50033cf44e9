"""Ranked text search: a positional inverted index, web-style queries, and the density of minimal covers.

The index has a row for each stem and text, with the places of its words; stop words have none but count in the places.  It is
built once, in one pass without a shuffle, and written by the caller, partitioned or sorted by term; a query reads the rows of its terms and
brings those of one text together.

A query is a list of alternatives (``or``), each of words and "quoted phrases" that must all occur, or must not (``-``).
A cover is a shortest stretch of a text that satisfies an alternative; it counts 0.1 / (1 + words in it that no query term is).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.functions import text as tx
from wellframe.functions.stem import STOP_WORDS, WHOLE, stem

WORD = re.compile(r"[^\W_]+")
WEIGHT = 0.1


def places(text: str) -> dict[str, list[int]]:
    """Each stem's places among all words, from 1."""
    out: dict[str, list[int]] = {}
    for i, m in enumerate(WORD.finditer(text.lower()), 1):
        if m[0] not in STOP_WORDS:
            out.setdefault(stem(m[0]), []).append(i)
    return out


def build(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, places of every text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.some_texts(b.column(1)):
                rows = [(t, i, p) for i, x in part for t, p in places(x).items()]
                terms, at, where = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch([pa.array(terms, pa.string()), b.column(0).take(pa.array(at, pa.int64())), pa.array(where, pa.list_(pa.int32()))], ["term", "key", "places"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"term string, key {kind}, places array<int>")


@dataclass(frozen=True)
class Phrase:
    """Stems and their distances from the first one; a word alone is a phrase of one."""

    terms: tuple[tuple[str, int], ...]
    wanted: bool = True

    def found(self, at: dict[str, list[int]]) -> list[tuple[int, int]]:
        """(first place, last place) of every occurrence, in order."""
        known = [set(at.get(t, ())) for t, _ in self.terms]
        last = self.terms[-1][1]
        return [(p, p + last) for p in at.get(self.terms[0][0], ()) if all(p + d in k for (_, d), k in zip(self.terms, known, strict=True))]


def parse(query: str) -> list[list[Phrase]]:
    """The alternatives of a web-style query.  Stop words ask for nothing; in a phrase they keep their place."""
    out: list[list[Phrase]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if bare == "or" and not minus:
            out.append([])
            continue
        words = list(enumerate(WORD.findall(quoted or bare)))
        terms = [(stem(w), i) for i, w in words if w not in STOP_WORDS]
        if terms:
            out[-1].append(Phrase(tuple((t, i - terms[0][1]) for t, i in terms), not minus))
    return [a for a in out if any(p.wanted for p in a)]


def covers(at: dict[str, list[int]], query: list[list[Phrase]]) -> Iterator[tuple[int, int]]:
    """The minimal covers (first place, last place) of a text whose stems are at these places, left to right."""
    able = []
    for alternative in query:
        found = [(p.wanted, p.found(at)) for p in alternative]
        if all(bool(f) == wanted for wanted, f in found):
            able.append([([a for a, _ in f], [b for _, b in f]) for wanted, f in found if wanted])
    here = 0
    while True:
        ends = []
        for phrases in able:
            nexts = [bisect_left(first, here) for first, _ in phrases]
            if all(i < len(first) for i, (first, _) in zip(nexts, phrases, strict=True)):
                ends.append(max(last[i] for i, (_, last) in zip(nexts, phrases, strict=True)))
        if not ends:
            return
        end, begin = min(ends), 0
        for phrases in able:
            befores = [bisect_right(last, end) - 1 for _, last in phrases]
            if min(befores) >= 0:
                begin = max(begin, min(first[i] for i, (first, _) in zip(befores, phrases, strict=True)))
        yield begin, end
        here = begin + 1


def density(at: dict[str, list[int]], query: list[list[Phrase]]) -> float:
    """The summed weight of all covers; 0 for a text that doesn't match."""
    named = sorted({p for a in query for x in a for t, _ in x.terms for p in at.get(t, ())})
    total = 0.0
    for begin, end in covers(at, query):
        inside = bisect_right(named, end) - bisect_left(named, begin)
        total += WEIGHT / (1 + (end - begin) - (inside - 1))
    return total


def search(index: DataFrame, queries: dict[str, str]) -> DataFrame:
    """query, key, rank of every text that matches one of the named queries."""
    spark: SparkSession = index.sparkSession
    parsed = {name: parse(q) for name, q in queries.items()}
    asked = [(t, name) for name, q in parsed.items() for t in {t for a in q for p in a for t, _ in p.terms}]
    kind = index.schema["key"].dataType.simpleString()
    terms = spark.createDataFrame(asked, "term string, query string")
    hits = index.where(F.col("term").isin(sorted({t for t, _ in asked}))).join(F.broadcast(terms), "term")  # as many terms as the queries have words
    texts = hits.groupBy("query", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = [density(dict(at.as_py()), parsed[q.as_py()]) for q, at in zip(b.column(0), b.column(2), strict=True)]  # one text's places at a time
            yield pa.record_batch([b.column(0), b.column(1), pa.array(rank, pa.float64())], ["query", "key", "rank"])

    return texts.mapInArrow(run, f"query string, key {kind}, rank double").where("rank > 0")


def matching(docs: DataFrame, text: str, queries: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` that may match one of the queries, by what all words of a stem begin with: no word leaves the JVM."""
    low, some = F.lower(F.col(text)), F.lit(False)
    for q in queries.values():
        for alternative in parse(q):
            every = F.lit(True)
            for t in {t for p in alternative if p.wanted for t, _ in p.terms if t not in WHOLE.values()}:
                every = every & F.contains(low, F.lit(t[:-1] if len(t) > 2 else t))
            some = some | every
    return docs.where(some)


def search_texts(docs: DataFrame, key: str, text: str, queries: dict[str, str]) -> DataFrame:
    """``search`` of texts that have no index: only those that may match are cut into words."""
    return search(build(matching(docs, text, queries), key, text), queries)


def write(index: DataFrame, path: str) -> None:
    """The index as Parquet in ranges of terms, so that a query's terms are read from few row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term", "key").write.mode("errorifexists").parquet(path)


#: How far down each ranking is fused, and the constant of reciprocal ranks (fixed values).
DEPTH, RRF = 50, 60.0


def fused(keyword: DataFrame, vectors: DataFrame) -> DataFrame:
    """key, score: reciprocal ranks of the DEPTH best by keyword (key, rank) and by vector (key, distance), ties by key."""
    from pyspark.sql import Window

    def best(df: DataFrame, order: list, name: str) -> DataFrame:
        top = df.orderBy(*order).limit(DEPTH)
        return top.select("key", F.row_number().over(Window.orderBy(*order)).alias(name))  # of DEPTH rows

    kw = best(keyword, [F.desc("rank"), F.col("key")], "k")
    vec = best(vectors, [F.col("distance"), F.col("key")], "v")
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return kw.join(vec, "key", "full").select("key", (share("k") + share("v")).alias("score"))


def answers(fused_: DataFrame, chunks: DataFrame, events: DataFrame, formation: str | None = None, field: str | None = None, event_type: str | None = None, md_from: float | None = None, md_to: float | None = None, limit: int = 20) -> DataFrame:
    """The best ``limit`` of the fused rows whose chunks pass the filters that are given.

    chunks: key, doc, page, formation, field, md_from, md_to; an open end passes, a chunk without a page has its document's events.
    """
    rows = chunks.join(F.broadcast(fused_), "key")  # twice DEPTH rows at most
    for name, value in (("formation", formation), ("field", field)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if md_from is not None:
        rows = rows.where(F.col("md_to").isNull() | (F.col("md_to") >= md_from))
    if md_to is not None:
        rows = rows.where(F.col("md_from").isNull() | (F.col("md_from") <= md_to))
    if event_type is not None:
        e = events.where(F.col("event_type") == event_type).select(F.col("doc").alias("e_doc"), F.col("page").alias("e_page")).distinct()
        rows = rows.join(e, (F.col("doc") == F.col("e_doc")) & (F.col("page").isNull() | (F.col("page") == F.col("e_page"))), "left_semi")
    return rows.orderBy(F.desc("score"), "key").limit(limit)
