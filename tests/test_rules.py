"""Rules of quantities, chunks, headers and joins on fixed examples."""

import math
import random
import time

from pyspark.sql import functions as F

from wellframe.functions import geo, text, units
from wellframe.operators import joins
from wellframe.sources import files


def test_quantities(spark):
    want = {
        "drilled 2395-2410 m": [(2395.0, "m"), (2410.0, "m")],
        "from 2395 to 2,410.5 ft": [(2395.0, "ft"), (2410.5, "ft")],
        "8,200 ft deep": [(8200.0, "ft")],
        "pulled 3 stands, then 2395m": [(2395.0, "m")],
        "lost 30 bbl/hr at 1200.5 m.": [(30.0, "bbl/hr"), (1200.5, "m")],
        "tag 12345": [],
        "-5 bar and 9.5 kN·m": [(-5.0, "bar"), (9.5, "kN·m")],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string")
    got = {r.t: r.q and [(x.value, x.unit) for x in r.q] for r in df.select("t", units.quantities(F.col("t")).alias("q")).collect()}
    assert got == want | {None: None}


def test_unit_spellings(spark):
    same = {" FT ": "ft", "bbl / hour": "bbl/h", "m3/hr": "m3/h", "L/hours": "l/h", "°": "deg", "m³": "m3", "kN·m": "kn.m", "gal[US]/min": "gal/min", "galUS": "gal", "lbf/100 ft²": "lbf/100ft2", "hr": "hr"}
    df = spark.createDataFrame(list(same.items()), "u string, w string")
    assert all(r.n == r.w for r in df.select("w", units.normalise_unit(F.col("u")).alias("n")).collect())


def test_headers():
    for t, want in {"MD (ft)": ("md", "ft"), "md_ft": ("md", "ft"), "Top TVD-SS [m]": ("top tvd ss", "m"), "Inclination": ("inclination", None), " Depth MD ( m ) ": ("depth md", "m"), "m": ("m", None), "Name ()": ("name", None)}.items():
        assert files.header(t) == want, t


def test_chunks():
    table = "\n".join(f"{i} | {i + 1} | {i + 2}" for i in range(40))
    page = "First line.\nSecond line.\n\n" + table + "\n\nThird line."
    assert text.pack(page, 200, 50) == ["First line.\nSecond line.", table, "Third line."]
    assert text.pack("a | b | c\nd | e | f", 200, 50) == ["a | b | c\nd | e | f"]  # two lines are no table
    assert text.pack("aaaa\nbbbb\ncccc\ndddd", 10, 5) == ["aaaa\nbbbb", "bbbb\ncccc", "cccc\ndddd"]
    assert text.pack("aaaa\nbbbb\ncccc", 10, 0) == ["aaaa\nbbbb", "cccc"]
    long = "One sentence is here. " * 20
    pieces = text.pack(long, 100, 10)
    assert all(p.endswith(".") and len(p) <= 100 for p in pieces) and " ".join(pieces) == long.strip()
    assert text.pack("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 5]
    assert text.pack(" \n\n ", 10, 3) == []


def test_asof_of_nulls_and_one_large_key(spark):
    left = spark.createDataFrame([(1, 5.0), (1, None), (1, 9.0), (2, 1.0)], "k long, x double")
    right = spark.createDataFrame([(1, 5.0, "a"), (1, 7.0, "b"), (1, None, "c")], "k long, x double, v string")
    get = lambda d: sorted((r.k, r.x or 0, r.asof_v) for r in joins.asof(left, right, ["k"], "x", ["v"], d).collect())
    assert get("backward") == [(1, 0, None), (1, 5.0, "a"), (1, 9.0, "b"), (2, 1.0, None)]
    assert get("forward") == [(1, 0, None), (1, 5.0, "a"), (1, 9.0, None), (2, 1.0, None)]
    one = spark.range(40_000).select(F.lit(0).alias("k"), F.col("id").cast("double").alias("x"), "id")
    began = time.time()
    assert joins.asof(one, one, ["k"], "x", ["id"], "forward").where("id <> asof_id").count() == 0
    assert time.time() - began < 60


def test_asof_steps(spark):
    rng = random.Random(1)
    steps = sorted({round(rng.random() ** 3 * 1000, 1) for _ in range(60)})
    points = [round(rng.uniform(-50, 1100), 1) for _ in range(300)] + steps + [None]
    df = spark.createDataFrame(list(enumerate(points)), "id long, x double")
    st = spark.createDataFrame([(s, f"s{s}") for s in steps], "x double, v string")
    got = joins.asof_steps(df, st, "x", ["v"]).collect()
    assert len(got) == len(points)
    for r in got:
        below = [s for s in steps if r.x is not None and s <= r.x]
        assert r.asof_v == (f"s{below[-1]}" if below else None)
    assert joins.asof_steps(df, st.limit(0), "x", ["v"]).where("asof_v is not null").count() == 0


def test_radius_up_to_the_poles(spark):
    rng = random.Random(2)
    pts = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(150)]
    pts += [(1000 + i, s * (90 - rng.random() * 0.3), rng.uniform(-180, 180)) for i in range(30) for s in (1, -1)][:60]
    pts += [(2000 + i, 79.9 + i * 0.05, 179.99 if i % 2 else -179.99) for i in range(10)] + [(3000, 90.0, 0.0), (3001, -90.0, 5.0)]
    pts = [(i, *p[1:]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    for r in (20_000.0, 700_000.0, 6_000_000.0):
        got = {(x.id, x.other_id) for x in joins.radius(df, df, r).collect()}
        a = df.select("id", "lat", "lon").crossJoin(df.select(F.col("id").alias("o"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))).where("id <> o")
        want = {(x.id, x.o) for x in a.where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= r).collect()}
        assert got == want and len(want) > 10


def test_nearest_within_a_radius_is_cut_by_weight(spark):
    rng = random.Random(4)
    pts = [(str(i), 20 + rng.random() * 3, 90 + rng.random() * 3, i % 4) for i in range(150)] + [(f"c{i}", 40 + rng.random() / 1000, 179.9995 + rng.random() / 1000, 1) for i in range(60)] + [("far", 60.0, 0.0, 1), ("few", 40.3, 179.9, 1)]
    df = spark.createDataFrame([(a, b, c if c <= 180 else c - 360, w) for a, b, c, w in pts], "id string, lat double, lon double, weight int")
    near = sorted(tuple(r) for r in joins.radius(df, df, 60_000.0, with_right=("weight",)).select("id", "distance_m", "other_id", "weight").collect())
    want, held = set(), {}
    for i, _, o, w in near:
        if w > 0 and held.get(i, 0) < 5:
            want.add((i, o))
            held[i] = held.get(i, 0) + w
    got = [(r.id, r.other_id) for r in joins.nearest_within(df.select("id", "lat", "lon"), df, 60_000.0, 5).collect()]
    assert set(got) == want and len(got) == len(want) > 300


def test_nearest_in_a_band_until_they_weigh_enough(spark, monkeypatch):
    """each row meets only what it may need, with stacks of one place, rows without a weight, and equal gaps on both sides."""
    r = random.Random(7)
    rows = [(i, r.choice("ab"), r.choice([None, *[round(r.uniform(0, 40), 1) for _ in range(6)], 5.0, 7.0, 9.0]), r.choice([None, 0, 1, 2, 5])) for i in range(160)]
    want = set()
    for i, k, x, _ in rows:
        before = 0
        for gap, o, w in sorted((abs(x - y), o, w) for o, q, y, w in rows if None not in (x, y) and q == k and o != i and w and abs(x - y) <= 6.0):
            if before < 9:
                want.add((i, o, gap, w))
            before += w
    df = spark.createDataFrame(rows, "id int, k string, x double, weight int")
    got = joins.nearest_in_band(df, ["k"], "x", 6.0, 9)
    assert {tuple(t) for t in got.collect()} == want and got.count() == len(want)
    # A thousand rows of one place: each meets some of them, not all.
    stack = spark.range(1000).selectExpr("int(id) AS id", "'a' AS k", "1.0D AS x", "1 AS weight")
    met, seen = joins.overlap, []
    monkeypatch.setattr(joins, "overlap", lambda *a: seen.append(met(*a)) or seen[-1])
    assert joins.nearest_in_band(stack, ["k"], "x", 6.0, 9).count() == 9000 and seen[0].count() < 15_000
