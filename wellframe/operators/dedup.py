"""Sequential deduplication: the first kept row wins."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.operators.stages import spread


def first_kept(df: DataFrame, keys: list[str], on: str, order: list[str], width: float) -> DataFrame:
    """Rows of each key (null-safe) in order, without those within ``width`` of one that was kept before.

    Whether a row is kept depends on all before it, so a key's rows meet in one task; they are first cut into runs
    whose neighbours in ``on`` are more than ``width`` apart, across which nothing can matter.  ``df`` is counted first, for the
    number of tasks.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(on)
    runs = spread(df, keys, df.count()).withColumn("_new", F.coalesce((F.col(on) - F.lag(on).over(w) > width).cast("int"), F.lit(0)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        use = []
        for x in pdf.sort_values(order)[on]:
            at = bisect_left(kept, x) if not pd.isna(x) else 0
            ok = pd.isna(x) or all(abs(x - k) > width for k in kept[max(at - 1, 0) : at + 1])  # kept ones are in order
            use.append(ok)
            if ok and not pd.isna(x):
                kept.insert(at, x)
        return pdf.sort_values(order)[use].drop(columns="_run")

    return runs.groupBy(*keys, "_run").applyInPandas(keep, df.schema)
