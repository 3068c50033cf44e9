"""Nearest neighbours by inner product, from several shifted Hilbert curves.

Vectors are scaled by the largest norm M and given one more coordinate, sqrt(1 - |x|^2 / M^2), which turns the largest
inner product into the smallest distance.  Each curve turns them by its own random projection to ``dims``
dimensions, shifts them by up to the cube's own width within a cube twice as wide, so that the coarse cells' borders fall
elsewhere too, quantises these, and orders them by the Hilbert index.  The order is cut into
``ranges`` ranges of equal numbers of vectors.  A query is compared with its own range and the ``reach``
ranges on either side of it: each range ranks its candidates in double precision, and the windows' best lists
of all curves merge.  Scores are summed component by component everywhere, so that ties are ties.

A query thus sees (2 reach + 1) / ranges of the vectors on each curve, the same share at every size; small tables are
cut into fewer ranges, of no fewer than 4 (k + 1) vectors.  A range of more
than ``max_rows`` vectors is cut into parts by a hash, and so are its queries; every part is searched by all of them.  On vectors without structure
no ordering of them helps much, so recall there is bought with the share seen: see the README for figures.

Equal vectors are one vector with its ``k + 1`` smallest ids, found by maxima of bounded size before rows move.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, or have another length
than most, take no part, neither as query nor as candidate; nor do rows with a null id.  Rows of the same id and
vector are one.  With fewer than k candidates in reach all are returned; an empty table gives no rows.  Ties
go to the smaller id.  Columns other than id and vector are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.llm.hilbert import hilbert_index
from wellframe.llm.staging import discard, staged

#: Vectors sampled to place the cuts, for each range and curve.
SAMPLE_PER_RANGE = 64


def projection(curve: int, width: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's random orthonormal directions and shift."""
    rng = np.random.default_rng([seed, curve])
    q, _ = np.linalg.qr(rng.normal(size=(width, dims)))
    return q, rng.uniform(0, 1, size=dims)


def curve_keys(x: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Hilbert indices of unit vectors (rows of ``x``) on one curve."""
    q, shift = projection(curve, x.shape[1], min(dims, x.shape[1]), seed)
    y = x @ q * np.sqrt(x.shape[1])  # about standard normal, if the vectors have no direction in common
    cells = np.clip(((y + 4) / 8 + shift) / 2 * (2**bits - 1), 0, 2**bits - 1)
    return hilbert_index(cells.astype(np.uint64), bits)


def valid_vectors(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).where(F.exists("v", lambda x: x != 0))


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """v, ids: each distinct vector with its ``n`` smallest ids.

    Ids are taken down to n for each vector and salt, by ever fewer salts, so that no task gets a vector's whole group.
    """
    rows = rows.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("salt"))
    for salts in (64, 8, 1):
        w = Window.partitionBy("v", F.pmod("salt", F.lit(salts))).orderBy("id")
        rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
        if salts > 1:
            rows = staged(rows, "ids")
    return rows.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def nearest(df: DataFrame, ident: str, vector: str, is_query: str, k: int = 20, curves: int = 9, dims: int = 4, bits: int = 7, ranges: int = 16, reach: int = 1, max_rows: int = 50_000, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id satisfies ``is_query`` (SQL on ``id``)."""
    spark = df.sparkSession
    rows = valid_vectors(df, ident, vector).distinct()
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = staged(rows.where(F.size("v") == (width[0][0] if width else 0)), "vectors")
    queries = staged(rows.where(is_query).select(F.col("id").alias("query_id"), "v"), "queries")
    groups = staged(smallest_ids(rows, k + 1), "groups")
    asked = queries.select("v").distinct().withColumn("asked", F.lit(True))
    asked = staged(asked, "asked")
    nodes = groups.join(asked, "v", "left").select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    nodes = staged(nodes, "nodes")
    n, n_asked, top = nodes.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    # A range holds four lists' worth of vectors at least, so that a window is never too small for one.
    ranges = max(1, min(ranges, n // (4 * (k + 1))))
    around = sorted({d % ranges for d in range(-reach, reach + 1)})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)) / top
            x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)
            node = b.column(0).to_numpy()
            for c in range(curves):
                yield pa.record_batch([pa.array(np.full(len(node), c, np.int32)), pa.array(curve_keys(x, c, dims, bits, seed)), pa.array(node)], ["curve", "key", "node"])

    placed = staged(nodes.select("node", "v").mapInArrow(keys, "curve int, key bigint, node bigint"), "keys")
    # Cuts from a sample of bounded size; equal keys are told apart by the node.
    rate = min(1.0, SAMPLE_PER_RANGE * ranges / n)
    at = [i / ranges for i in range(1, ranges)]
    picked = placed.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) + 1))
    cuts = {r.curve: r.cuts for r in picked.groupBy("curve").agg(F.percentile_approx("key", at, 10_000).alias("cuts")).collect()}
    table = np.array([cuts.get(c) or [0] * (ranges - 1) for c in range(curves)], dtype=np.int64)
    parts = max(1, -(-n // (ranges * max_rows)))
    q_parts = max(1, -(-n_asked * len(around) // (ranges * max_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            curve, key, node, ask = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            lo = np.array([np.searchsorted(table[c], x, "left") for c, x in zip(curve, key, strict=True)], dtype=np.int64)
            hi = np.array([np.searchsorted(table[c], x, "right") for c, x in zip(curve, key, strict=True)], dtype=np.int64)
            own = lo + (node * 2654435761 % 1000003) % (hi - lo + 1)  # a key on several cuts is spread over their ranges
            part = (node * 40503 % 65521) % parts
            # Candidates are in one part, for the queries of every part; queries the other way round.
            out = [(curve, own, part * q_parts + p, node, np.zeros(len(node), bool)) for p in range(q_parts)]
            q_part = (node * 48271 % 65521) % q_parts
            q = np.flatnonzero(ask)
            for d in around:
                r = (own[q] + d) % ranges  # the curve's ends meet, so that every query sees as much
                for p in range(parts):
                    out.append((curve[q], r, p * q_parts + q_part[q], node[q], np.ones(len(q), bool)))
            cols = [np.concatenate([o[i] for o in out]) for i in range(5)]
            yield pa.record_batch([pa.array((cols[0] * ranges + cols[1]) * (parts * q_parts) + cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4])], ["cell", "node", "asks"])

    dealt = placed.join(nodes.select("node", "asked"), "node").select("curve", "key", "node", "asked").mapInArrow(deal, "cell bigint, node bigint, asks boolean")
    full = dealt.join(nodes.select("node", "v", F.col("ids")[0].alias("least_id")), "node").select("cell", "asks", "node", "least_id", "v")

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        node, least_id = table.column("node").to_numpy(), table.column("least_id").to_numpy()
        v = np.stack(table.column("v").combine_chunks().to_numpy(zero_copy_only=False))
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = [[], [], [], []]
        take = min(k + 1, len(c))
        near = 1e-9 * top * top  # more than sums in another order differ by
        for lo in range(0, len(q), 512) if len(c) else ():
            rows = q[lo : lo + 512]
            s = v[rows] @ v[c].T
            bound = np.partition(s, len(c) - take, axis=1)[:, len(c) - take]
            at, to = np.nonzero(s >= bound[:, None] - near)
            score = np.zeros(len(at))
            for j in range(v.shape[1]):
                score += v[rows[at], j] * v[c[to], j]
            order = np.lexsort((least_id[c[to]], -score, at))
            at, to, score = at[order], to[order], score[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at, "left") < take
            for o, x in zip(out, (node[rows[at]], node[c[to]], least_id[c[to]], score), strict=True):
                o.append(x[keep])
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(x.astype(np.int64)) for x in cols[:3]] + [pa.array(cols[3].astype(float))], names=["q", "c", "least_id", "s"])

    best = full.groupBy("cell").applyInArrow(rank, "q bigint, c bigint, least_id bigint, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "least_id")
    best = best.groupBy("q", "c", "least_id").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    # Ids in place of vectors.
    near = staged(best.select("q", "c", F.col("s").alias("score")), "near")
    scored = near.join(nodes.select(F.col("node").alias("c"), "ids"), "c")
    found = staged(scored.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found")), "found")
    lists = staged(nodes.where("asked").join(found.withColumnRenamed("q", "node"), "node").select("v", "found"), "lists")
    merged = queries.join(lists, "v").select("query_id", F.explode("found").alias("f")).select("query_id", "f.score", F.explode("f.ids").alias("vec_id")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = staged(merged.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    discard(rows, queries, groups, asked, nodes, placed, near, found, lists)
    return out
