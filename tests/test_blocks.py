"""Pairs made block by block: the same as pairs made by joins, whatever the blocks."""

from pyspark.sql import functions as F
from wellframe.operators import blocks, joins, lookahead, wells
from wellframe.plans import reports
from wellframe.plans.registry import Tables
from wellframe.functions import geo


def _field(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    f = reports.field(t)
    crowd = lambda df, c: df.crossJoin(spark.range(12).withColumnRenamed("id", "n")).withColumn(c, F.concat_ws("-", c, F.col("n").cast("string"))).drop("n")
    w = crowd(f["wells"], "well_id").withColumns({"lon": F.col("lon") + F.length("well_id") * 0.01, "lat": F.col("lat") + F.pmod(F.xxhash64("well_id"), F.lit(50)) * 0.01})
    b = w.select(F.col("well_id").alias("wellbore_id"), "well_id", F.lit(True).alias("is_primary"))
    return f | {"wells": w, "wellbores": b, "stations": crowd(f["stations"], "wellbore_id"), "events": crowd(f["events"].limit(50), "wellbore_id")}


def test_depth_pairs_do_not_depend_on_blocks(spark, monkeypatch):
    f = _field(spark)
    probes = f["wellbores"].select("wellbore_id", F.lit(1200.0).alias("md_m"))
    run = lambda: sorted(tuple(r) for r in wells.offsets_within(f["wells"], f["wellbores"], f["stations"], probes, f["events"], 120_000.0, mode="depth", ordered=False).collect())
    whole = run()
    monkeypatch.setattr(blocks, "HELD", 7)
    assert run() == whole and len(whole) > 500
    # Vertical wells are as far from each other below as above: these pairs come from the joins as well.
    ids = wells.wellbore_points(f["wells"], f["wellbores"]).select(F.col("wellbore_id").alias("id"), "lat", "lon")
    near = {(r.id, r.other_id): r.distance_m for r in joins.radius(ids, ids, 119_000.0, geo.geodesic_m).collect()}
    got = {r[:2]: r[2] for r in whole}
    assert near.keys() <= got.keys() and all(abs(got[k] - d) < 1e-6 for k, d in near.items())


def test_rates_within_are_those_of_single_pairs(spark, monkeypatch):
    n = F.col("id")
    points = spark.range(60).select(n.cast("string").alias("wellbore_id"), (20 + (n * 37 % 97) / 100.0).alias("lat"), (90 + (n * 53 % 101) / 100.0).alias("lon"))
    k = F.col("wellbore_id").cast("int")
    name = lambda i: F.concat(F.lit("f"), (i % 2).cast("string"))
    intervals = points.select(F.col("wellbore_id").alias("interval_id"), name(k).alias("formation"), F.when(k % 5 > 0, k % 7 / 10.0).alias("relative_depth"), F.lit(1200.0).alias("md_mid_m"), F.when(k != 11, 1000.0 + k).alias("top_md_m"))
    tops = points.where("wellbore_id % 7 <> 3").select("wellbore_id", F.explode(F.array(F.lit("f0"), F.lit("f1"))).alias("formation"), F.when(k != 8, 1010.0 + k).alias("top_md_m"))
    i = F.col("i")
    e = points.where("wellbore_id % 4 <> 1").select("wellbore_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i"))
    e = e.select("wellbore_id", F.concat_ws("-", "wellbore_id", i.cast("string")).alias("event_id"), F.when(i % 9 == 0, None).when(i % 3 == 0, "kick").when(i % 3 == 1, "losses").otherwise("other").alias("risk_type"), name(i).alias("formation"))
    j = F.split("event_id", "-")[1].cast("int")
    e = e.select("*", F.when(j % 4 > 0, j % 11 / 10.0).alias("relative_depth"), F.when(j % 13 > 0, 1150.0 + j * 5).alias("md_from_m"), F.when(j % 5 == 0, "rejected").when(j % 2 == 0, "pending").otherwise("approved").alias("review_status"), F.when(j % 6 > 0, 1 - j / 100.0).alias("confidence"))
    at = points.select(F.col("wellbore_id").alias("id"), "lat", "lon")
    near = joins.radius(at, at, 40_000.0, geo.geodesic_m).select(F.col("id").alias("interval_id"), F.col("other_id").alias("wellbore_id"), "distance_m")
    near = near.join(intervals.select("interval_id", "formation"), "interval_id").join(tops, ["wellbore_id", "formation"]).select("interval_id", "wellbore_id", (F.col("distance_m") * 0.1).alias("depth_distance_m"), F.lit(True).alias("drilled"), "top_md_m")
    digits = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("interval_id", "risk_type", F.coalesce("l1", F.lit(-1.0)), "n_offsets", F.coalesce("mean_conf", F.lit(-1.0)), "n_unreviewed").collect())
    want = digits(wells.l1_scores(intervals, near, e))
    assert any(r[4] > 0 and r[5] > 0 for r in want)
    for held, events in ((4096, 4096), (5, 3)):
        monkeypatch.setattr(blocks, "HELD", held)
        monkeypatch.setattr(lookahead, "EVENTS", events)
        assert digits(lookahead.rates_within(intervals, points, tops, e, 40_000.0, 0.1)) == want
