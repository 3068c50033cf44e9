"""Risk scores computed and stored: fused by hand, purged by rule."""

import pytest
from pyspark.sql import functions as F

from wellframe.functions import risk
from wellframe.operators import scores


def test_computed_and_stored(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    bits = s([("a", 1010.0), ("b", 500.0)], "wellbore_id string, bit_md_m double")
    rates = s([("a", 1000.0, "kick", 0.5, 3, 0.9), ("a", 1025.0, "kick", 0.1, 1, 0.1), ("a", 5000.0, "kick", 1.0, 1, 1.0), ("a", 1050.0, "kick", None, 0, None), ("b", 500.0, "losses", 0.2, 2, 0.3)], "wellbore_id string, md_from_m double, risk_type string, l1 double, n_offsets int, mean_conf double")
    models = s([("a", 1000.0, "kick", 0.7)], "wellbore_id string, md_from_m double, risk_type string, l2 double")
    detectors = s([("a", "kick", 1.0, 75.0)], "wellbore_id string, risk_type string, l3 double, floor double")
    now = F.timestamp_seconds(F.lit(100))
    new = scores.computed(bits, rates, models, detectors, now)
    got = {(r.wellbore_id, r.md_from_m): r for r in new.collect()}
    assert set(got) == {("a", 1000.0), ("a", 1025.0), ("b", 500.0)}
    fused = spark.range(1).select(risk.fuse([F.lit(0.5), F.lit(0.7), F.lit(1.0)], F.lit(75.0)).alias("x"), risk.fuse([F.lit(0.1), F.lit(None).cast("double"), F.lit(None).cast("double")], F.lit(None).cast("double")).alias("y")).first()
    assert got["a", 1000.0].fused == pytest.approx(fused.x) and got["a", 1000.0].fused >= 75 and got["a", 1000.0].confidence == "high"
    assert got["a", 1025.0].fused == pytest.approx(fused.y) and got["a", 1025.0].l3 is None and got["a", 1025.0].confidence == "low"
    old = s([("a", 900.0, "kick"), ("a", 1000.0, "kick"), ("a", 1012.5, "kick"), ("a", 1000.0, "losses"), ("c", 9000.0, "kick")], "wellbore_id string, md_from_m double, risk_type string").select("*", *[F.lit(None).cast("double").alias(c) for c in ("md_to_m", "l1", "l2", "l3", "fused")], F.lit("low").alias("band"), F.lit("low").alias("confidence"), F.timestamp_seconds(F.lit(1)).alias("computed_at"))
    starts = s([("a", 1000.0), ("b", 500.0), ("c", 0.0)], "wellbore_id string, start_m double")
    out = {(r.wellbore_id, r.md_from_m, r.risk_type): r.computed_at.timestamp() for r in scores.stored(old, new, starts).collect()}
    assert set(out) == {("a", 900.0, "kick"), ("a", 1000.0, "kick"), ("a", 1025.0, "kick"), ("b", 500.0, "losses"), ("c", 9000.0, "kick")}
    assert out["a", 1000.0, "kick"] > out["a", 900.0, "kick"]
