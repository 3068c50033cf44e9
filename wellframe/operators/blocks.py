"""Pairs within a radius made by Arrow functions, some rows of a cell against some others, so that no pair is a row before it is a result.

The joins of ``joins.radius`` make each pair a row of Spark's and send it to Python and back for its distance.  Where the pairs
are summed up or are far more than the rows, a task gets the rows of its cells, sorted, and makes the pairs of a block itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.functions import geo
from wellframe.operators import joins

#: Left rows of a cell that are held at a time, and pairs that are measured at a time.
HELD, PAIRS = 4096, 1 << 16


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles; nulls become NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


class Held:
    """The left rows of one block: ``rows``, and their places as doubles."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.lat, self.lon, self.code = numbers(self.rows, "l_lat"), numbers(self.rows, "l_lon"), self.rows.column("l_code").to_numpy()
        self.unit = _unit(self.lat, self.lon)

    def near(self, right: pa.RecordBatch, radius_m: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(some right rows, their numbers, left rows' numbers, metres) of all pairs of different ids within the radius, by right rows."""
        chord = 2 * math.sin(min(math.pi, radius_m * 1.01 / geo.EARTH_RADIUS_M) / 2)
        step = max(1, PAIRS // len(self.lat))
        for at in range(0, right.num_rows, step):
            some = right.slice(at, step)
            lat, lon = numbers(some, "r_lat"), numbers(some, "r_lon")
            j, i = np.nonzero(_unit(lat, lon) @ self.unit.T >= 1 - chord * chord / 2 - 1e-15)
            same = np.flatnonzero(some.column("r_code").to_numpy()[j] == self.code[i])
            if len(same):  # equal hashes: the ids themselves decide
                a, b = some.column("r_id").take(pa.array(j[same])), self.rows.column("l_id").take(pa.array(i[same]))
                drop = [n for n, x, y in zip(same, a.to_pylist(), b.to_pylist(), strict=True) if x == y]
                j, i = np.delete(j, drop), np.delete(i, drop)
            d = geo.spheroid_m(lat[j], lon[j], self.lat[i], self.lon[i])
            fits = d <= radius_m
            yield some, j[fits], i[fits], d[fits]


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def near(left: DataFrame, right: DataFrame, keys: list[str], radius_m: float, block: Callable[[Held, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: list[str] = [], max_lat: float = 80.0) -> DataFrame:  # noqa: B006
    """The rows of ``block`` for every block of left rows and the right rows of its cell, both with equal keys.

    Both sides: id, lat, lon, keys and further columns; a block has them as l_... and r_..., the right ones sorted by ``order``.  Left
    rows are copied to all cells within the radius and held, HELD on average; right rows are in their own cell once, and stream past.
    """
    own, copied = joins._cells(radius_m, max_lat)
    cell = ["cy", "cx", *keys]
    point = lambda df: df.where("lat is not null and lon is not null").withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double"), "code": F.xxhash64("id")})
    l, r = copied(point(left)), own(point(right))
    blocks = l.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("_n"))
    l = l.join(blocks, cell).withColumn("_g", F.pmod("code", "_n").cast("int"))
    r = r.join(blocks, cell).withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at, last = [*cell, "_g"], [c for c in order]
    named = lambda df, side, p: df.drop("_n").select(*at, F.lit(side).alias("_s"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in (*at, "_n")])
    both = named(l, 0, "l").unionByName(named(r, 1, "r"), allowMissingColumns=True)
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, *at).sortWithinPartitions(*at, "_s", *[f"r_{c}" for c in last])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(c) for c in (*at, "_s")]
            change = np.zeros(n, bool)
            for c in cols:
                c = c.dictionary_encode().indices.to_numpy(zero_copy_only=False) if not pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False)
                change[1:] |= c[1:] != c[:-1]
            ends = [0, *np.flatnonzero(change).tolist(), n]
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield tuple(c[lo].as_py() for c in cols[:-1]), cols[-1][lo].as_py(), b.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = pieces(batches)
        piece = next(todo, None)
        while piece:
            key, held = piece[0], []
            while piece and piece[0] == key and piece[1] == 0:
                held.append(piece[2])
                piece = next(todo, None)

            def rights() -> Iterator[pa.RecordBatch]:
                nonlocal piece
                while piece and piece[0] == key and piece[1] == 1:  # noqa: B023
                    yield piece[2]
                    piece = next(todo, None)

            if held:
                yield from block(Held(held), rights())
            for _ in rights():  # what the block left
                pass

    return both.mapInArrow(run, schema)
