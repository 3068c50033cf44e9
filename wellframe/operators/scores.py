"""The table of risk scores: computed for the cells ahead of each bit, stored by key, rows of older runs purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.functions import risk
from wellframe.operators import wells

KEY = ["wellbore_id", "md_from_m", "risk_type"]


def computed(bits: DataFrame, rates: DataFrame, models: DataFrame, detectors: DataFrame, at: Column, cells: int = 12) -> DataFrame:
    """wellbore_id, md_from_m, md_to_m, risk_type, l1, l2, l3, fused, band, confidence, computed_at of every cell and risk with a score.

    bits: wellbore_id, bit_md_m; rates: KEY, l1, n_offsets, mean_conf; models: KEY, l2; detectors: wellbore_id, risk_type, l3, floor, which
    count in the bit's own cell.
    """
    grid = wells.lookahead(bits, cells).select("wellbore_id", "bit_md_m", "md_from_m", "md_to_m")
    x = grid.join(rates, ["wellbore_id", "md_from_m"]).join(models, KEY, "left").join(detectors, ["wellbore_id", "risk_type"], "left")
    here = (F.col("md_from_m") <= F.col("bit_md_m")) & (F.col("bit_md_m") < F.col("md_to_m"))
    x = wells.fused_scores(x.withColumns({"l3": F.when(here, F.col("l3")), "floor": F.when(here, F.col("floor"))}))
    return x.select("wellbore_id", "md_from_m", "md_to_m", "risk_type", "l1", "l2", "l3", "fused", "band", risk.confidence(F.col("n_offsets"), F.col("mean_conf")).alias("confidence"), at.alias("computed_at"))


def stored(old: DataFrame, new: DataFrame, starts: DataFrame) -> DataFrame:
    """The table after a run: new rows replace old ones of their key; old ones from the window's start on, which the run did not
    refresh, go; what lies above the start, and wells without a new row, stay.  starts: wellbore_id, start_m.

    One shuffle by key and one small one by well; a keyed or partitioned table is written from the result, well by well.
    """
    # A well's start is needed only where the run scored it.
    ran = new.select("wellbore_id").distinct().join(starts, "wellbore_id").groupBy("wellbore_id").agg(F.min("start_m").alias("_start"))
    kept = old.join(new.select(*KEY), KEY, "left_anti").join(ran, "wellbore_id", "left").where("_start is null or md_from_m < _start")
    return kept.select(new.columns).unionByName(new)
