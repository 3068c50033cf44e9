"""Citations and the number check by example, and against the rules in plain code."""

import re

from wellframe.functions import citations as c


def test_quantities(spark):
    cases = {
        "lost 15 m3/h at 2,410 m, 1,5 sg": {(15.0, "m3/h"), (2410.0, "m"), (1.5, "sg")},
        "for 3 hours (3h) and 12.5 kN.m.": {(3.0, "h"), (12.5, "kn.m")},
        "40% at 60 °C; 5 m/s": {(40.0, "%"), (60.0, "degc"), (5.0, "m")},
        "x12 m, .5 m, 7 mud, 1,2,3 m, 8 stands": set(),
        "1,234,567.5 psi": {(1234567.5, "psi")},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: {tuple(q) for q in r.q} for r in df.withColumn("q", c.quantities(df.t)).collect()} == cases


def test_cleaned(spark):
    cases = {"Losses [1, 9] at 5 m [2].": "Losses [1] at 5 m [2].", "None [9] .": "None.", "[a] [1,,2] [ 2 , 1 ] x [3] ,": "[a] [1,,2] [2][1] x,", "": "", "plain": "plain"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    from pyspark.sql import functions as F

    valid = F.array(F.lit(1), F.lit(2))
    assert {r.t: r.x for r in df.withColumn("x", c.cleaned(df.t, valid)).collect()} == cases


def test_checked(spark):
    answers = [
        (1, "Losses were 15 m3/h [1]. Pressure was 90 bar [2]. It took 3 hours. See [1]! [2] Depth 2,410 m?\n\n- Mud 1.2 sg [2]"),
        (2, "No source for 5 m."),
        (3, "Nothing to check"),
        (4, None),
    ]
    sources = [(1, 1, "15 m3/h of losses, 3 hrs"), (1, 2, "90 bar; 1.3 sg"), (3, 1, "x")]
    got = {r.id: r for r in c.checked(spark.createDataFrame(answers, "id int, a string"), spark.createDataFrame(sources, "id int, n int, t string"), "id", "a", "n", "t").collect()}
    assert got[1].a == "Losses were 15 m3/h [1]. Pressure was 90 bar [2]. It took 3 hours. See [1]! [2]".replace(" See [1]! [2]", "")
    assert got[1].removed and [tuple(q) for q in got[1].unsupported] == [(2410.0, "m"), (1.2, "sg")] and got[1].uncited == ["It took 3 hours."]
    assert (got[2].a, got[2].removed, got[2].uncited) == ("", True, ["No source for 5 m."])
    assert (got[3].a, got[3].removed, got[3].unsupported) == ("Nothing to check", False, [])


def test_registered_answers(spark, sf):
    """The query's counts, by the rules in plain code."""
    from wellframe.plans.registry import QUERIES

    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    for r in QUERIES["fn35_checked_answers"](spark, sf).collect():
        size = parts[r.p_partkey].p_size
        lacks = [(float(size + 1), "m")] if r.p_partkey % 2 else []
        assert (r.removed, r.n_unsupported, r.n_uncited) == (bool(lacks), len(lacks), 1)
        assert r.answer == f"It was {size} m [1]." + ("" if lacks else f" Then {size} m [2].") + " End."
        assert not re.search(r"\[9\]", r.answer)
