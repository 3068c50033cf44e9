"""Joins that Spark has no name for: as-of, nearest, bracket, radius, band and overlap.

None of them is a nested loop: as-of joins are one window over the union of both sides, range joins become
equi-joins on cells that are as wide as the range.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import geo
from wellframe.operators.stages import dealt, spread, written


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: list[str], direction: str = "backward", tie: str | None = None) -> DataFrame:
    """Each left row with the right row of its keys whose ``on`` is nearest below (backward) or above (forward), equal included.

    Right columns come as ``asof_<name>``, among them ``asof_<on>``; null where there is none.  One shuffle by the keys;
    of right rows with equal ``on`` the last by ``tie`` counts going backward, the first going forward.  A null ``on`` meets nothing.
    """
    last = direction == "backward"
    payload = F.struct(F.col(on).alias(on), *[F.col(v).alias(v) for v in value])
    side = F.lit(0 if last else 2)
    r = right.where(F.col(on).isNotNull()).select(*keys, F.col(on).alias("_on"), payload.alias("_r"), side.alias("_s"), (F.col(tie) if tie else F.lit(0)).cast("double").alias("_t"))
    left_cols = left.columns
    row = left.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_s"), F.lit(0.0).alias("_t"), F.struct(*left_cols).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(row.schema["_l"].dataType)).unionByName(row.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    # Forward runs down the same order, so that the frame grows by a row at a time either way.
    order = ["_on", "_s", "_t"]
    w = Window.partitionBy(*keys).orderBy(*(order if last else map(F.desc, order))).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.when(F.col("_on").isNotNull(), F.last("_r", ignorenulls=True).over(w))
    out = both.withColumn("_p", pick).where("_l is not null")
    return out.select("_l.*", F.col(f"_p.{on}").alias(f"asof_{on}"), *[F.col(f"_p.{v}").alias(f"asof_{v}") for v in value])


def asof_steps(left: DataFrame, steps: DataFrame, on: str, value: list[str]) -> DataFrame:
    """As-of backward on one key that all rows share: ``steps`` (distinct ``on``) as half-open intervals, dealt into cells.

    A cell is as wide as a step on average, so that there are some two rows of cells for each step.  No task gets all rows, and
    if the steps are few Spark sends them to the rows.
    """
    lo, hi, n = steps.agg(F.min(on), F.max(on), F.count(on)).first()
    width = (hi - lo) / n if n and hi > lo else 1.0
    lo, last = (lo, int((hi - lo) // width)) if n else (0.0, 0)
    cell = lambda c: F.least(F.floor((c - lo) / width), F.lit(last))
    till = F.lead(on).over(Window.orderBy(on)) if n else F.lit(None).cast("double")  # the steps alone are in one order
    s = steps.where(F.col(on).isNotNull()).select(F.col(on).alias("_from"), *[F.col(v).alias(f"asof_{v}") for v in value], till.alias("_till"))
    s = s.withColumn("_c", F.explode(F.sequence(cell(F.col("_from")), F.coalesce(cell(F.col("_till")), F.lit(last)))))
    at = left.withColumn("_c", cell(F.col(on)))
    inside = (at["_c"] == s["_c"]) & (F.col("_from") <= F.col(on)) & (F.col("_till").isNull() | (F.col(on) < F.col("_till")))
    return at.join(s, inside, "left").select(*left.columns, F.col("_from").alias(f"asof_{on}"), *[f"asof_{v}" for v in value])


def around(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: list[str], tie: str | None = None) -> DataFrame:
    """``left`` with ``_lo`` and ``_hi``: structs of ``on`` and the values of the last right row at or before it and the first at or after.

    Both come from one shuffle: the two orders share its partitions.  Ties are as in ``asof``; a null ``on`` meets nothing.
    """
    payload = F.struct(F.col(on).alias(on), *[F.col(v).alias(v) for v in value if v != on])
    r = right.where(F.col(on).isNotNull()).select(*keys, F.col(on).alias("_on"), F.lit(0).alias("_s"), (F.col(tie) if tie else F.lit(0)).cast("double").alias("_t"), payload.alias("_r"))
    row = left.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_s"), F.lit(0.0).alias("_t"), F.struct(*left.columns).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(row.schema["_l"].dataType)).unionByName(row.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    w = Window.partitionBy(*keys)
    up, down = w.orderBy("_on", "_s", "_t"), w.orderBy(F.desc("_on"), "_s", F.desc("_t"))  # right rows of the same place come first in both
    near = lambda order: F.when(F.col("_on").isNotNull(), F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.withColumns({"_lo": near(up), "_hi": near(down)}).where("_l is not null").select("_l.*", "_lo", "_hi")


def bracket(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str]) -> DataFrame:
    """Linear interpolation of ``values`` at each left row, clamped to the first and last right row; ``interp_<name>``."""
    both = around(left, right, keys, on, values)
    x, x0, x1 = F.col(on), F.col("_lo")[on], F.col("_hi")[on]

    def at(v: str) -> Column:
        y0, y1 = F.col("_lo")[v], F.col("_hi")[v]
        return F.when(x0.isNull(), y1).when(x1.isNull(), y0).otherwise(geo.interpolate(x, x0, y0, x1, y1))

    return both.select(*left.columns, *[at(v).alias(f"interp_{v}") for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: list[str], tie: str) -> DataFrame:
    """Each left row with the right row whose ``on`` is nearest; equal distances go to the smaller ``tie``."""
    names = list(dict.fromkeys([on, *value, tie]))
    both = around(left, right, keys, on, names)
    lo, hi = F.col("_lo"), F.col("_hi")
    down, up = F.abs(lo[on] - F.col(on)), F.abs(hi[on] - F.col(on))
    use_lo = hi.isNull() | (down < up) | ((down == up) & (lo[tie] <= hi[tie]))
    return both.select(*left.columns, *[F.when(use_lo, lo[c]).otherwise(hi[c]).alias(f"near_{c}") for c in names])


#: Cells for each radius.  A pair is looked for in a square some 1.7 times the circle, and a row is copied to 49 cells.
FINE = 3


def _cells(radius_m: float, max_lat: float):
    """Two functions for points (lat, lon): one adds the cell (cy, cx) of each, one copies each to all cells within ``radius_m``.

    Each band of latitude has columns of its own width, so that cells are no wider than they must be.  Longitudes wrap at 180 degrees.
    Bands that reach beyond ``max_lat``, or with no room for the columns, are one cell each.
    """
    dlat = radius_m / geo.metres_per_degree(0.0)[0] * 1.01
    high = 180 / max(1, math.floor(180 / (dlat / FINE)))
    max_lat = min(max_lat, 89.0 - 2 * dlat)
    band_of = F.floor((F.col("lat") + 90.0) / high).cast("int")
    far = F.greatest(F.abs(F.col("cy") * high - 90), F.abs((F.col("cy") + 1) * high - 90))
    cols = F.floor(360 * FINE / dlat * F.cos(F.radians(far + 2 * dlat))).cast("int")
    cols = F.when((far <= max_lat) & (cols > 2 * FINE), cols).otherwise(1)
    column = F.floor((F.col("lon") + 180.0) / (360.0 / F.col("_n"))).cast("int")
    steps = F.array(*[F.lit(i) for i in range(-FINE, FINE + 1)])

    def own(df: DataFrame) -> DataFrame:
        return df.withColumn("cy", band_of).withColumn("_n", cols).withColumn("cx", F.pmod(column, F.col("_n"))).drop("_n")

    def copied(df: DataFrame) -> DataFrame:
        out = df.withColumn("_i", F.explode(steps)).withColumn("cy", band_of + F.col("_i")).withColumn("_n", cols)
        out = out.withColumn("_i", F.explode(F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(steps)))
        return out.withColumn("cx", F.pmod(column + F.col("_i"), F.col("_n"))).drop("_n", "_i")

    return own, copied


def _unit(lat: Column, lon: Column) -> list[Column]:
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def radius(left: DataFrame, right: DataFrame, radius_m: float, exact=geo.haversine_m, max_lat: float = 80.0, with_left: tuple[str, ...] = (), with_right: tuple[str, ...] = (), also: Column | None = None) -> DataFrame:
    """Pairs of (id, lat, lon) rows with different ids within ``radius_m``: id, other_id, distance_m and the further columns named.

    Cells are a third of the radius, only the right side is copied to all near ones.  Pairs whose chord is too long by more than
    a hundredth are left out before ``exact`` is asked.  ``also`` is a test of the pair's columns (of the right: lat2, lon2).
    """
    own, copied = _cells(radius_m, max_lat)
    l = own(left.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *with_left))
    l = l.withColumns(dict(zip(("_x", "_y", "_z"), _unit(F.col("lat"), F.col("lon")))))
    r = copied(right.select(F.col("id").alias("other_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *with_right)).withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    r = r.withColumns(dict(zip(("_x2", "_y2", "_z2"), _unit(F.col("lat2"), F.col("lon2")))))
    gap = lambda c: (F.col(f"_{c}") - F.col(f"_{c}2")) * (F.col(f"_{c}") - F.col(f"_{c}2"))
    chord = 2 * math.sin(min(math.pi, radius_m * 1.01 / geo.EARTH_RADIUS_M) / 2)
    near = (F.col("id") != F.col("other_id")) & (gap("x") + gap("y") + gap("z") <= chord * chord + 1e-15)
    pairs = dealt(l, ["cy", "cx"]).join(dealt(r, ["cy", "cx"]).hint("merge"), ["cy", "cx"]).where(near if also is None else near & also)
    d = exact(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return pairs.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).select("id", "other_id", "distance_m", *with_left, *with_right)


def nearest_within(left: DataFrame, right: DataFrame, radius_m: float, need: float, exact=geo.haversine_m) -> DataFrame:
    """Of the pairs of ``radius`` the nearest of each left row (distinct ids), ties to the smaller other_id, until their weights reach ``need``.

    right: id, lat, lon, weight (above 0).  It begins with the radius at which the densest cell's rows have enough, and doubles it for the
    rows that do not: what lies within a radius is known whole, so the nearest of those that have enough are final.
    """
    left, right = written(left), written(right.where("weight > 0"))
    cells = _cells(radius_m, 80.0)[0](right).groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    most, rows, weight = cells.agg(F.max("n"), F.sum("n"), F.sum("w")).first()
    enough = max(1.0, need * rows / weight) if rows else 1.0
    r = min(radius_m, radius_m / FINE * math.sqrt(2 * enough / (math.pi * most))) if rows else radius_m
    w, found = Window.partitionBy("id").orderBy("distance_m", "other_id"), []
    while True:
        near = radius(left, right, r, exact, with_right=("weight",))
        near = near.withColumn("_before", F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < need)
        near = written(near.select("id", "other_id", "distance_m", "weight"))
        if r >= radius_m:
            found.append(near)
            break
        done = near.groupBy("id").agg(F.sum("weight").alias("w")).where(F.col("w") >= need).select("id")
        found.append(near.join(done, "id", "left_semi"))
        left = written(left.join(done, "id", "left_anti"))
        if left.isEmpty():
            break
        r = min(radius_m, 2 * r)
    return reduce(DataFrame.unionByName, found).select("id", "other_id", "distance_m")


def band(left: DataFrame, right: DataFrame, keys: list[str], l_on: str, r_on: str, width: float) -> DataFrame:
    """Pairs of equal keys with |l_on - r_on| <= width: an equi-join on buckets of that width and a test."""
    l = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(l_on) / width) + i for i in (-1, 0, 1)])))
    r = right.withColumn("_b", F.floor(F.col(r_on) / width))
    return l.join(r, [*keys, "_b"]).where(F.abs(F.col(l_on) - F.col(r_on)) <= width).drop("_b")


def nearest_in_band(rows: DataFrame, keys: list[str], on: str, width: float, need: int) -> DataFrame:
    """Of the pairs of rows (distinct id, keys, ``on``, weight) of equal keys within ``width`` the nearest of each, ties to the smaller other_id.

    id, other_id, gap, weight: as many as weigh ``need`` together; those without a weight above 0 are no neighbours.  On a line
    the weight of what lies between two rows is a difference of running sums, so both sides of each row are looked for in ranges
    of these sums, and a row meets only what it may need, however many are within ``width``.
    """
    fine = F.col(on) / (width * 1e-9)  # differences of rows as near as this may be rounded to one another
    w, same = F.coalesce("weight", F.lit(0)), Window.partitionBy(*keys, on)
    by = Window.partitionBy(*keys)
    up, down = by.orderBy(fine), by.orderBy(fine.desc())
    sum_ = lambda over: F.coalesce(F.sum("weight").over(over), F.lit(0))
    nearer = lambda order: sum_(order.rangeBetween(Window.unboundedPreceding, -1))
    x = rows.where(F.col(on).isNotNull()).select("id", *keys, on, w.alias("weight"))
    x = x.withColumns({"_up": nearer(up), "_down": nearer(down), "_own": sum_(same.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), "_all": sum_(same)})
    x = x.withColumns({"_below": sum_(by.orderBy(on).rangeBetween(Window.unboundedPreceding, 0)) - F.col("_all"), "_above": sum_(by.orderBy(F.desc(on)).rangeBetween(Window.unboundedPreceding, 0))})
    side = lambda n, lo, hi: F.struct(F.lit(n).alias("_side"), lo.alias("_lo"), hi.alias("_hi"))
    asks = F.array(side(0, F.col("_below"), F.col("_below") + F.col("weight") + need), side(1, F.col("_above"), F.col("_above") + need))
    asks = x.select("id", *keys, F.col(on).alias("_x"), F.inline(asks)).withColumnsRenamed({"_lo": "l_from", "_hi": "l_to"})
    ends = ((F.col("_up"), F.col("_below")), (F.col("_down"), F.col("_above") - F.col("_all")))
    at = F.array(*[side(i, lo + F.col("_own"), hi + F.col("_own") + 1) for i, (lo, hi) in enumerate(ends)])
    others = x.where("weight > 0").select(F.col("id").alias("other_id"), *keys, F.col(on).alias("_y"), "weight", F.inline(at)).withColumnsRenamed({"_lo": "r_from", "_hi": "r_to"})
    gap = F.abs(F.col("_x") - F.col("_y"))
    met = overlap(asks, others, [*keys, "_side"], float(need)).where((F.col("id") != F.col("other_id")) & ((F.col("_side") == 0) == (F.col("_y") >= F.col("_x"))) & (gap <= width))
    order = Window.partitionBy("id").orderBy("gap", "other_id").rowsBetween(Window.unboundedPreceding, -1)
    return met.select("id", "other_id", gap.alias("gap"), "weight").withColumn("_before", sum_(order)).where(F.col("_before") < need).drop("_before")


def overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: float, closed: bool = False, rows: int | None = None) -> DataFrame:
    """Pairs of equal keys whose intervals [l_from, l_to) and [r_from, r_to) overlap, or those with their upper ends if ``closed``.

    Intervals are dealt into the buckets that they touch; a pair counts in the bucket where the later one begins.  Both sides are
    shuffled: Spark takes a dealt side for no larger than it was, and would send it whole through the driver.  With ``rows``, of both
    sides, the tasks follow their number.
    """

    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        first, some = F.floor(F.col(lo) / bucket), F.col(hi) >= F.col(lo) if closed else F.col(hi) > F.col(lo)
        last = F.floor(F.col(hi) / bucket) if closed else F.greatest(first, F.ceil(F.col(hi) / bucket) - 1)
        out = df.where(some).withColumn("_b", F.explode(F.sequence(first, last)))
        return out if rows is None else spread(out, [*keys, "_b"], rows)

    both = dealt(left, "l_from", "l_to").join(dealt(right, "r_from", "r_to").hint("merge"), [*keys, "_b"])
    meet = (F.col("l_from") <= F.col("r_to")) & (F.col("r_from") <= F.col("l_to")) if closed else (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to"))
    return both.where(meet & (F.col("_b") == F.floor(F.greatest("l_from", "r_from") / bucket))).drop("_b")


def full_rank_fusion(a: DataFrame, b: DataFrame, ident: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (ident, rank): the sum of 1 / (k + rank) over those that have it."""
    both = a.select(ident, F.col("rank").alias("ra")).join(b.select(ident, F.col("rank").alias("rb")), ident, "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select(ident, "ra", "rb", (part("ra") + part("rb")).alias("rrf"))
