"""Greedy one-to-one matching of many rows at once.

Greedy matching takes edges in one order and keeps those whose ends are both free.  ``edges`` works in parallel rounds on given
edges of any order: an edge that is the first one of both its ends is kept whatever else happens, so each round keeps all of these
and removes their ends; the result is that of the sequential rule.  ``nearest`` matches places on a line, the smallest gap first,
without making pairs.  Rows of one place are a stack, and the smallest gap of all is always one between neighbouring stacks, so a
task follows the sequential rule along its stretches of the line.  A key of many rows is cut into stretches; what may hang on rows
beyond a stretch stays open and is matched over other stretches.  A stretch of too many rows is matched in rounds: stacks look for
their nearest ones, and stacks that have only each other are matched by rank at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellframe.operators.stages import TASK_ROWS, cut, spread, written

#: Rows of a stretch that a task holds at most, and tolerances that a stretch of a longer key is wide.
HELD, WIDE = TASK_ROWS, 16


def edges(pairs: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """The rows of ``pairs`` that greedy matching keeps, in the order of these columns, then ``a`` and ``b``.

    Ends are compared as they are; rows with a null end are never kept, of repeated pairs one is.
    """
    rank = F.struct(*order, a, b)
    free = cut(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).dropDuplicates([a, b]).withColumn("_rank", rank))
    kept = free.limit(0)
    while not free.isEmpty():
        best = lambda end: free.groupBy(end).agg(F.min("_rank").alias("_best"))  # noqa: B023, E731
        first = cut(free.join(best(a), a).where("_rank = _best").drop("_best").join(best(b), b).where("_rank = _best").select(free.columns))
        kept = kept.unionByName(first)
        free = cut(free.join(first.select(a), a, "left_anti").join(first.select(b), b, "left_anti"))
    return kept.drop("_rank")


def _nearest_places(places: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, x, side, y, gap: for every place the one or two places of the other side that are nearest, within ``tolerance``.

    Places are dealt to cells as wide as the tolerance, and to both neighbours of their own as well, so that a large key is
    many groups.
    """
    home = F.floor(F.col("x") / tolerance)
    dealt = places.select(*keys, "x", "side", home.alias("home"), F.explode(F.array(home - 1, home, home + 1)).alias("cell"))
    near: list[Column] = []
    for order, frame in ((F.col("x").asc(), "below"), (F.col("x").desc(), "above")):
        w = Window.partitionBy(*keys, "cell").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        for side in (0, 1):
            near.append(F.last(F.when(F.col("side") == side, F.col("x")), ignorenulls=True).over(w).alias(f"{frame}{side}"))
    seen = dealt.select("*", *near).where("cell = home")
    other = lambda frame: F.when(F.col("side") == 0, F.col(f"{frame}1")).otherwise(F.col(f"{frame}0"))
    seen = seen.select(*keys, "x", "side", F.explode(F.array_distinct(F.array(other("below"), other("above")))).alias("y"))
    seen = seen.withColumn("gap", F.abs(F.col("x") - F.col("y"))).where(F.col("gap") <= tolerance)
    least = F.min("gap").over(Window.partitionBy(*keys, "side", "x"))
    return seen.withColumn("least", least).where("gap = least").drop("least")


def along(xs: list[float], sides: list[int], tolerance: float, low: float, high: float) -> tuple[list[tuple[int, int, float]], list[int]]:
    """(row of side 0, row of side 1, gap) of the pairs, and the rows that are open, of one stretch whose rows are in the order of their ids.

    Rows below ``low`` and above ``high`` are unknown.  What one of them may take is open from that gap on, and so is what an open
    row may take; all else is as if the whole line were known.
    """
    at: dict[float, tuple[list[int], list[int]]] = {}
    for i, (x, side) in enumerate(zip(xs, sides, strict=True)):
        at.setdefault(x, ([], []))[side].append(i)
    pairs: list[tuple[int, int, float]] = []
    place, of, stack = [low], [-1], [[-1]]
    for x in sorted(at):
        a, b = at[x]
        n = min(len(a), len(b))
        pairs += ((i, j, 0.0) for i, j in zip(a[:n], b[:n], strict=True))
        if len(a) != len(b):
            place.append(x)
            of.append(int(len(b) > n))
            stack.append((a[n:] or b[n:])[::-1])  # the first row last
    end = len(place)
    before, after = list(range(-1, end)), list(range(1, end + 2))
    open_: list[int] = []
    # The nearest unknown or open row of each side: its place and its first row.
    ends = {0: [(low, -1), (low, -1)], end: [(high, -1), (high, -1)]}
    heap: list[tuple[float, int, int, int, int]] = []

    def edge(m: int, n: int) -> tuple[float, int, int, int, int] | None:
        """The first edge between two neighbours, if they have any."""
        if m in ends and n in ends:
            return None
        if m in ends or n in ends:
            inner = n if m in ends else m
            side, row = of[inner], stack[inner][-1]
            x, other = ends[m if m in ends else n][1 - side]
            gap = place[inner] - x if m in ends else x - place[inner]
        else:
            side, row, other = of[m], stack[m][-1], stack[n][-1]
            if side == of[n]:
                return None
            gap = place[n] - place[m]
        if gap > tolerance:
            return None
        return (gap, row, other, m, n) if side == 0 else (gap, other, row, m, n)

    def push(m: int, n: int) -> None:
        if e := edge(m, n):
            heappush(heap, e)

    def leave(m: int) -> None:
        before[after[m]], after[before[m]] = before[m], after[m]
        after[m] = -1

    for m in range(end):
        push(m, m + 1)
    while heap:
        e = heappop(heap)
        gap, a, b, m, n = e
        if after[m] != n:
            continue
        now = edge(m, n)
        if now != e:  # rows of it are gone
            if now:
                heappush(heap, now)
        elif m in ends or n in ends:
            outer, inner = (m, n) if m in ends else (n, m)
            ends[outer][of[inner]] = (place[inner], stack[inner][-1])
            open_ += stack[inner]
            leave(inner)
            push(*((outer, after[outer]) if outer == 0 else (before[outer], outer)))
        else:
            pairs.append((a, b, gap))
            stack[m].pop()
            stack[n].pop()
            left, right = m if stack[m] else before[m], n if stack[n] else after[n]
            for gone in (m, n):
                if not stack[gone]:
                    leave(gone)
            push(left, right)
    return pairs, open_


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, so that none of the tables ends within a stretch; ``n`` is 1 at the first row of each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        first = np.flatnonzero(b.column("n").to_numpy() == 1)
        if len(first):
            held.append(b.slice(0, first[-1]))
            yield pa.Table.from_batches(held)
            held = []
            b = b.slice(first[-1])
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _stretches(rows: DataFrame, keys: list[str], tolerance: float, shift: float, count: int) -> DataFrame:
    """keys, a, b, gap, side, x: the pairs, and with a null gap and the id as ``a`` the open rows, of (keys, stretch, side, x, id)."""
    width = WIDE * tolerance
    w = Window.partitionBy(*keys, "stretch").orderBy("id")
    rows = spread(rows, [*keys, "stretch"], count).select(*keys, "stretch", "side", "x", "id", F.row_number().over(w).alias("n"))
    id_ = rows.schema["id"].dataType
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], T.StructField("a", id_), T.StructField("b", id_), T.StructField("gap", T.DoubleType()), T.StructField("side", T.IntegerType()), T.StructField("x", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            first = [*np.flatnonzero(t.column("n").to_numpy() == 1).tolist(), t.num_rows]
            xs, sides = t.column("x").to_pylist(), t.column("side").to_pylist()
            pairs: list[tuple[int, int, float]] = []
            open_: list[int] = []
            for i, s in enumerate(t.column("stretch").take(pa.array(first[:-1], pa.int64())).to_pylist()):
                low, high = float("-inf"), float("inf")
                at, to = first[i], first[i + 1]
                if s is not None:
                    slack = width * 1e-9 + abs(xs[at]) * 1e-14  # bounds are rounded
                    low, high = (s - shift) * width + slack, (s + 1 - shift) * width - slack
                got, left = along(xs[at:to], sides[at:to], tolerance, low, high)
                pairs += ((at + a, at + b, gap) for a, b, gap in got)
                open_ += (at + r for r in left)
            a, b, gap = zip(*pairs, strict=True) if pairs else ((), (), ())
            m, n = len(a), len(open_)
            # Pairs first, then the open rows; null where one has no such column.
            rows_a, rows_b = pa.array([*a, *open_], pa.int64()), pa.array([*b, *[None] * n], pa.int64())
            lone = pa.array([*[None] * m, *open_], pa.int64())
            columns = [*[t.column(k).take(rows_a) for k in keys], t.column("id").take(rows_a), t.column("id").take(rows_b), pa.array([*gap, *[None] * n], pa.float64()), t.column("side").take(lone), t.column("x").take(lone)]
            yield from pa.table(columns, names=[*keys, "a", "b", "gap", "side", "x"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], x: str, row: str, tolerance: float) -> DataFrame:
    """keys, a, b, gap: rows of both sides matched within their keys, by (gap, row of the left, row of the right).

    ``row`` identifies a row of its side.  Rows with a null key, place or id match nothing; nor do infinite places.
    A key of up to HELD rows is one stretch, a longer one is cut.  A stack of rows of one key and place is sorted in one task.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    side = lambda df, n: df.select(*keys, F.col(x).cast("double").alias("x"), F.col(row).alias("id"), F.lit(n).alias("side"))
    free = side(left, 0).unionByName(side(right, 1)).dropna()
    free = written(free.where(~F.isnan("x") & (F.abs("x") < float("inf"))))
    kept, shift, before = None, 0.0, None
    add = lambda new: new if kept is None else kept.unionByName(new)
    while True:
        count = free.count()
        if kept is not None and not count:
            return kept
        if before is not None and count > before / 2:  # most are in stretches of too many rows
            return add(_rounds(cut(free), keys, tolerance))
        over = lambda df, by: cut(df.groupBy(*by).count().where(F.col("count") > HELD).select(*by))
        long, whole = over(free, keys), F.lit(None).cast("long").alias("stretch")
        rows, full = free.select("*", whole), None
        if not long.isEmpty():  # at most one key and one stretch for every HELD rows
            pieces = free.join(F.broadcast(long), keys).withColumn("stretch", F.floor(F.col("x") / (WIDE * tolerance) + shift))
            heavy = over(pieces, [*keys, "stretch"])
            full = pieces.join(F.broadcast(heavy), [*keys, "stretch"], "left_semi").select(free.columns)
            rows = free.join(F.broadcast(long), keys, "left_anti").select("*", whole).unionByName(pieces.join(F.broadcast(heavy), [*keys, "stretch"], "left_anti"))
        got = written(_stretches(rows, keys, tolerance, shift, count))
        kept = add(got.where("gap is not null").select(*keys, "a", "b", "gap"))
        if full is None:
            return kept
        free = written(got.where("gap is null").select(*keys, "x", F.col("a").alias("id"), "side").unionByName(full))
        shift, before = 0.5 - shift, count


def _rounds(free: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The same of (keys, side, x, id) in rounds of nearest stacks."""
    kept = None
    while True:
        places = free.groupBy(*keys, "side", "x").agg(F.min("id").alias("top"))
        near = cut(_nearest_places(places, keys, tolerance).join(places, [*keys, "side", "x"]))
        if near.isEmpty():
            break
        ways = near.withColumn("ways", F.count("*").over(Window.partitionBy(*keys, "side", "x")))
        a = ways.where("side = 0").select(*keys, F.col("x").alias("xa"), F.col("y").alias("xb"), "gap", F.col("top").alias("ia"), F.col("ways").alias("wa"))
        b = ways.where("side = 1").select(*keys, F.col("y").alias("xa"), F.col("x").alias("xb"), F.col("top").alias("ib"), F.col("ways").alias("wb"))
        both = cut(a.join(b, [*keys, "xa", "xb"]))  # each is among the other's nearest
        of_a, of_b = Window.partitionBy(*keys, "xa"), Window.partitionBy(*keys, "xb")
        both = both.select("*", F.count("*").over(of_a).alias("ma"), F.count("*").over(of_b).alias("mb"), F.max("wb").over(of_a).alias("loose_b"), F.max("wa").over(of_b).alias("loose_a"), F.min(F.struct("ib", "xb")).over(of_a).alias("fa"), F.min(F.struct("ia", "xa")).over(of_b).alias("fb"))
        # A star: the middle has all its ways among these, the others have no way but to it.  A single pair is one as well.
        star_a = (F.col("ma") == F.col("wa")) & (F.col("loose_b") == 1)
        star_b = (F.col("mb") == F.col("wb")) & (F.col("loose_a") == 1)
        middle = F.when(star_a, F.col("xa")).when(star_b, F.col("xb"))
        stars = both.where(star_a | star_b).withColumn("middle", middle)
        members = stars.select(*keys, "middle", "gap", F.lit(0).alias("side"), F.col("xa").alias("x")).unionByName(stars.select(*keys, "middle", "gap", F.lit(1).alias("side"), F.col("xb").alias("x"))).distinct()
        ranked = free.join(members, [*keys, "side", "x"]).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "middle", "side").orderBy("id")))
        of = lambda n, name: ranked.where(F.col("side") == n).select(*keys, "middle", "r", "gap", F.col("id").alias(name))  # noqa: B023, E731
        new = of(0, "a").join(of(1, "b").drop("gap"), [*keys, "middle", "r"]).select(*keys, "a", "b", "gap")
        # Of longer chains, at ends that have all their ways among these, the edges that are first at both ends of all of these.
        chain = both.where(~(star_a | star_b) & (F.col("ma") == F.col("wa")) & (F.col("mb") == F.col("wb")))
        heads = chain.where("fa.xb = xb and fb.xa = xa").select(*keys, "ia", "ib", "gap")
        new = cut(new.unionByName(heads.select(*keys, F.col("ia").alias("a"), F.col("ib").alias("b"), "gap")))
        kept = new if kept is None else kept.unionByName(new)
        used = new.select(*keys, F.lit(0).alias("side"), F.col("a").alias("id")).unionByName(new.select(*keys, F.lit(1).alias("side"), F.col("b").alias("id")))
        free = cut(free.join(used, [*keys, "side", "id"], "left_anti"))
    if kept is None:
        kept = free.select(*keys, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("gap")).limit(0)
    return kept
