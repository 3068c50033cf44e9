"""Matching in rounds against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from wellframe.operators import matching


def sequential(rows):
    """Edges (order..., a, b) taken in order."""
    used_a, used_b, out = set(), set(), set()
    for e in sorted(set(rows)):
        if e[-2] not in used_a and e[-1] not in used_b:
            used_a.add(e[-2]), used_b.add(e[-1])
            out.add(e)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edges_equal_sequential(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(4), r.randrange(30), r.randrange(30)) for _ in range(200)]
    best = {}
    for w, a, b in sorted(rows):
        best.setdefault((a, b), w)
    rows = [(w, a, b) for (a, b), w in best.items()]
    df = spark.createDataFrame([*rows, (0, None, 3), (0, 4, None)], "w int, a int, b int")
    assert {tuple(x) for x in matching.edges(df, "a", "b", ["w"]).select("w", "a", "b").collect()} == sequential(rows)


def on_a_line(left, right, tolerance):
    return sequential([(k, abs(x - y), i, j) for k, x, i in left for q, y, j in right if k == q and abs(x - y) <= tolerance])


@pytest.mark.parametrize(("seed", "places", "tolerance"), [(1, 12, 3), (2, 6, 5), (3, 1000, 40), (4, 2, 1), (5, 40, 2)])
def test_nearest_equals_sequential(spark, seed, places, tolerance):
    r = random.Random(seed)
    side = lambda n: [(r.choice("xy"), float(r.randrange(-places, places)), i) for i in r.sample(range(1000), n)]
    left, right = side(60), side(50)
    schema = "k string, x double, id int"
    out = matching.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "x", "id", float(tolerance)).collect()
    assert {(t.k, t.gap, t.a, t.b) for t in out} == on_a_line(left, right, tolerance) and len(out) == len({(t.k, t.a) for t in out})


def test_first_of_all_ways_not_only_of_closed_ones(spark):
    """Row 1 of the left is as far from rows 1 and 2 of the right; row 1 has one more way, to a row that has a nearer one."""
    left, right = [("x", 14.0, 1), ("x", 8.0, 2)], [("x", 11.0, 1), ("x", 17.0, 2), ("x", 7.0, 3)]
    df = lambda rows: spark.createDataFrame(rows, "k string, x double, id int")
    got = {tuple(r) for r in matching.nearest(df(left), df(right), ["k"], "x", "id", 5.0).select("k", "gap", "a", "b").collect()}
    assert got == on_a_line(left, right, 5.0) == {("x", 1.0, 2, 3), ("x", 3.0, 1, 1)}
    free = df(left).withColumn("side", F.lit(0)).unionByName(df(right).withColumn("side", F.lit(1)))
    assert {tuple(r) for r in matching._rounds(free, ["k"], 5.0).select("k", "gap", "a", "b").collect()} == got


def test_stretches_leave_open_what_hangs_on_others():
    """What a stretch settles is as in the whole line, and the rule goes on with what is open as if all were left."""
    rule = lambda rows: {e[1:] for e in on_a_line([("", x, i) for i, (x, side) in rows.items() if side == 0], [("", x, i) for i, (x, side) in rows.items() if side == 1], 5.0)}
    opened = 0
    for seed in range(300):
        r = random.Random(seed)
        x = r.choice([lambda: float(r.randrange(60)), lambda: r.uniform(0, 60)])  # noqa: B023
        rows = dict(enumerate((x(), r.randrange(2)) for _ in range(r.randrange(60))))
        low = r.uniform(0, 30)
        inside = [i for i, (x, _) in rows.items() if low <= x < low + 30]
        pairs, open_ = matching.along([rows[i][0] for i in inside], [rows[i][1] for i in inside], 5.0, low, low + 30)
        got = {(gap, inside[a], inside[b]) for a, b, gap in pairs}
        left = {i: v for i, v in rows.items() if i not in inside or i in {inside[o] for o in open_}}
        assert got | rule(left) == rule(rows) and len(got) + len(rule(left)) == len(rule(rows))
        opened += len(open_)
    assert opened


@pytest.mark.parametrize(("held", "rounds"), [(1000, False), (45, False), (8, True)])
def test_long_keys_are_cut(spark, monkeypatch, held, rounds):
    """Keys of up to ``held`` rows are one stretch and need no rounds; longer ones are cut, and crowded stretches are matched in rounds."""
    r, ran, by = random.Random(held), [], matching._rounds
    monkeypatch.setattr(matching, "HELD", held)
    monkeypatch.setattr(matching, "_rounds", lambda *a: ran.append(1) or by(*a))
    side = lambda n: [(k, float(r.randrange(900)) / 2 if k == "x" else r.uniform(0, 200), i) for i in range(n) for k in (r.choice("xxxxy"),)]
    left, right = side(150), side(160)
    df = lambda rows: spark.createDataFrame(rows, "k string, x double, id int")
    out = matching.nearest(df(left), df(right), ["k"], "x", "id", 3.0).collect()
    assert {(t.k, t.gap, t.a, t.b) for t in out} == on_a_line(left, right, 3.0) and len(out) == len({(t.k, t.a) for t in out}) and bool(ran) == rounds


def test_a_long_chain_takes_one_round(spark, monkeypatch):
    """Each gap is smaller than the one before, so that a match waits for the next: as many rounds of nearest ones as pairs."""
    ran, by = [], matching._nearest_places
    monkeypatch.setattr(matching, "_nearest_places", lambda *a: ran.append(1) or by(*a))
    xs = [0.0]
    for i in range(20):
        xs.append(xs[-1] + 4 - i / 10)
    side = lambda n: [("k", x, i) for i, x in enumerate(xs) if i % 2 == n]
    df = lambda rows: spark.createDataFrame(rows, "k string, x double, id int")
    out = matching.nearest(df(side(0)), df(side(1)), ["k"], "x", "id", 5.0).collect()
    assert {(t.k, t.gap, t.a, t.b) for t in out} == on_a_line(side(0), side(1), 5.0) and not ran


def test_one_hot_group(spark):
    """A third of the rows in one key, 100,000 in one place of each side: matched by rank in one round."""
    from pyspark.sql import functions as F

    side = lambda n, shift: spark.range(n).select(F.lit("hot").alias("k"), F.when(F.col("id") < 100_000, 5.0).otherwise((F.col("id") * 20 + shift).cast("double")).alias("x"), "id")
    out = matching.nearest(side(150_000, 0), side(140_000, 1), ["k"], "x", "id", 3.0)
    got = out.groupBy("gap").agg(F.count("*").alias("n"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("same")).collect()
    assert {(g.gap, g.n, g.same) for g in got} == {(0.0, 100_000, 100_000), (1.0, 40_000, 40_000)}


def test_nothing_to_match(spark):
    df = spark.createDataFrame([("k", 1.0, 1), (None, 1.0, 2), ("k", None, 3), ("k", float("nan"), 4), ("k", float("inf"), 5)], "k string, x double, id int")
    far = spark.createDataFrame([("k", 9.0, 1), ("q", 1.0, 2)], "k string, x double, id int")
    assert matching.nearest(df, far, ["k"], "x", "id", 2.0).collect() == [] == matching.nearest(df.limit(0), far, ["k"], "x", "id", 2.0).collect()


def test_registered_reports_equal_the_sequential_rule(spark, sf):
    from wellframe.plans.registry import QUERIES

    rows = spark.read.parquet(f"{sf}/events.parquet").collect()
    risk = {"view": "visit", "click": "visit", "error": "other", "signup": "other"}
    pred, true = [r for r in rows if r.event_id % 2], [r for r in rows if r.event_id % 2 == 0]
    found = {}
    for page in {r.user_id for r in rows}:
        cand = []
        for p in (r for r in pred if r.user_id == page):
            for t in (r for r in true if r.user_id == page and abs(p.value - r.value) <= 2.0):
                same = p.event_type == t.event_type
                if same or risk.get(p.event_type, 0) == risk.get(t.event_type, 1):
                    cand.append((-1.0 if same else -0.5, abs(p.value - t.value), p.event_id, t.event_id))
        found[page] = -sum(e[0] for e in sequential(cand))
    got = {r.doc_type: r for r in QUERIES["cq17_extraction_report"](spark, sf).collect()}
    for kind in ("0", "1", "2", "all"):
        of = lambda x: kind == "all" or x.user_id % 3 == int(kind)  # noqa: B023, E731
        want = sum(v for k, v in found.items() if kind == "all" or k % 3 == int(kind))
        assert (got[kind].found, got[kind].predicted, got[kind].truth) == (pytest.approx(want), sum(map(of, pred)), sum(map(of, true)))
        assert got[kind].precision == pytest.approx(want / got[kind].predicted, abs=1e-4)
    tops = {(r.page, r.a, r.b) for r in QUERIES["jn20_matched_tops"](spark, sf).collect()}
    free, want = sorted(pred, key=lambda r: r.event_id), set()
    for t in sorted(true, key=lambda r: r.event_id):
        hit = next((p for p in free if (p.user_id, p.event_type) == (t.user_id, t.event_type) and abs(p.value - t.value) <= 5), None)
        if hit:
            free.remove(hit)
            want.add((t.user_id, hit.event_id, t.event_id))
    assert tops == want
    seen, sides = {}, {"R": [], "A": []}
    for r in sorted(spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag in ('R', 'A')").collect(), key=lambda r: r.l_quantity):
        line = (r.l_suppkey, r.l_returnflag, r.l_orderkey, r.l_linenumber)
        seen[line] = seen.get(line, 0) + 1
        sides[r.l_returnflag].append((r.l_suppkey, r.l_quantity, (r.l_suppkey, *line[2:], seen[line])))
    kept = sorted((r.k, r.a, r.b) for r in QUERIES["jn19_greedy_match"](spark, sf).collect())
    assert kept == sorted((k, a[1], b[1]) for k, _, a, b in on_a_line(sides["R"], sides["A"], 5.0))


def test_extraction_report_takes_no_rounds(spark, sf, monkeypatch):
    """Events of a page are matched in one pass for each score, and what is matched is written once."""
    from wellframe.operators import evaluation
    from wellframe.plans.registry import QUERIES

    ran, by = [], matching._nearest_places
    monkeypatch.setattr(matching, "_nearest_places", lambda *a: ran.append("round") or by(*a))
    monkeypatch.setattr(evaluation, "cut", lambda df: ran.append("cut") or df)
    assert QUERIES["cq17_extraction_report"](spark, sf).count() == 4 and not ran
