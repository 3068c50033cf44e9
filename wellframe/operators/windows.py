"""Ordered-sequence operators as window expressions, shared by batch and stream checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def zscore(value: Column, w: WindowSpec, before: int = 60, least: int = 20) -> Column:
    """Against the ``before`` rows before this one, nulls skipped; population deviation with a floor; null below ``least`` values."""
    past = w.rowsBetween(-before, -1)
    mean, sd, n = F.avg(value).over(past), F.stddev_pop(value).over(past), F.count(value).over(past)
    return F.when((n >= least) & value.isNotNull(), (value - mean) / F.greatest(sd, 0.01 * F.abs(mean), F.lit(1e-6)))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], condition: Column, t: str) -> DataFrame:
    """``df`` with island (number of its run, null outside) and held (time since the run began)."""
    w = series(keys, order)
    ok = F.coalesce(condition, F.lit(False))
    marked = df.withColumn("_ok", ok).withColumn("_prev", F.coalesce(F.lag("_ok").over(w), F.lit(False)))
    marked = marked.withColumn("island", F.when(F.col("_ok"), F.sum((F.col("_ok") & ~F.col("_prev")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    run = Window.partitionBy(*keys, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col("_ok"), F.col(t) - F.min(t).over(run)).otherwise(0)
    return marked.withColumn("held", held).drop("_ok", "_prev")


def trailing(df: DataFrame, keys: list[str], on: str, value: str, width: float, least: int = 3) -> DataFrame:
    """mean and slope (for each ``width``) of ``value`` over (on - width, on]; null below ``least`` values.

    The frame is closed, so rows at exactly on - width are taken off by sums over their own frame.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(on).cast("double"))
    x, y = F.col(on).cast("double"), F.col(value).cast("double")
    full, edge = w.rangeBetween(-width, 0), w.rangeBetween(-width, -width)
    s = lambda e: F.coalesce(F.sum(e).over(full), F.lit(0.0)) - F.coalesce(F.sum(e).over(edge), F.lit(0.0))
    n = F.count(y).over(full) - F.count(y).over(edge)
    x0 = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = df.withColumn("_x", F.when(y.isNotNull(), x - x0)).withColumn("_n", n)
    xs = F.col("_x")
    out = out.withColumns({"_sy": s(y), "_sx": s(xs), "_sxy": s(xs * y), "_sxx": s(xs * xs)})
    det = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.when(det > 1e-9, (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.nullif(det, F.lit(0.0))).otherwise(0.0)
    ok = F.col("_n") >= least
    return out.withColumn("mean", F.when(ok, F.col("_sy") / F.col("_n"))).withColumn("slope", F.when(ok, slope * width)).drop("_x", "_n", "_sy", "_sx", "_sxy", "_sxx")


def repaired(df: DataFrame, keys: list[str], order: list[str], value: str, gap: float = 5.0) -> DataFrame:
    """``fixed``: values raised so that each is at least the one before plus ``gap``; ``raised`` by how much.

    Closed form of the sequential rule: fixed_k = gap k + max over j <= k of (v_j - gap j).
    """
    w = series(keys, order)
    k = F.row_number().over(w)
    out = df.withColumn("_k", k).withColumn("_e", F.col(value) - gap * F.col("_k"))
    out = out.withColumn("fixed", gap * F.col("_k") + F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("raised", F.col("fixed") - F.col(value)).drop("_k", "_e")


def downsampled(df: DataFrame, keys: list[str], order: list[str], by: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each key: of equal runs of rows that with the largest ``by``, else the first."""
    w = series(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = df.withColumn("_i", F.row_number().over(w)).withColumn("_step", F.greatest(F.lit(1), F.ceil(n / limit)))
    out = out.withColumn("_b", F.floor((F.col("_i") - 1) / F.col("_step")))
    best = out.groupBy(*keys, "_b").agg(F.max_by(F.struct(*df.columns), F.struct(F.coalesce(F.col(by).cast("double"), F.lit(float("-inf"))), -F.col("_i"))).alias("r"))
    return best.select("r.*")


def minimum_curvature(stations: DataFrame, key: str) -> DataFrame:
    """tvd, north, east and dogleg severity of survey stations (md_m, inc_deg, azi_deg), summed from the first."""
    from wellframe.functions.geo import dogleg_rad, ratio_factor

    w = Window.partitionBy(key).orderBy("md_m")
    s = stations.withColumns({f"_{c}": F.lag(c).over(w) for c in ("md_m", "inc_deg", "azi_deg")})
    beta = dogleg_rad(F.col("_inc_deg"), F.col("_azi_deg"), F.col("inc_deg"), F.col("azi_deg"))
    dmd = F.col("md_m") - F.col("_md_m")
    s = s.withColumn("_beta", beta).withColumn("_half", dmd / 2 * ratio_factor(F.col("_beta")))
    i0, i1, a0, a1 = (F.radians(c) for c in ("_inc_deg", "inc_deg", "_azi_deg", "azi_deg"))
    parts = {"tvd_m": F.cos(i0) + F.cos(i1), "north_m": F.sin(i0) * F.cos(a0) + F.sin(i1) * F.cos(a1), "east_m": F.sin(i0) * F.sin(a0) + F.sin(i1) * F.sin(a1)}
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumns({n: F.coalesce(F.sum(F.col("_half") * e).over(run), F.lit(0.0)) for n, e in parts.items()})
    out = out.withColumn("tvd_m", F.col("tvd_m") + F.first("md_m").over(run))
    return out.withColumn("dls_deg_per_30m", F.coalesce(F.degrees("_beta") / F.nullif(dmd, F.lit(0.0)) * 30, F.lit(0.0))).select(key, "md_m", "inc_deg", "azi_deg", "tvd_m", "north_m", "east_m", "dls_deg_per_30m")
