"""Queries over whole tables, against brute force."""

from collections import defaultdict

from wellframe.plans import registry


def lines(spark, sf):
    return sorted(spark.read.parquet(f"{sf}/lineitem.parquet").collect(), key=lambda r: (r.l_orderkey, r.l_linenumber))


def test_first_kept_of_all_rows(spark, sf):
    kept, want = defaultdict(list), set()
    for r in lines(spark, sf):
        k = kept[r.l_suppkey, r.l_returnflag]
        if all(abs(x - r.l_quantity) > 5 for x in k):
            k.append(r.l_quantity)
            want.add((r.l_orderkey, r.l_linenumber))
    assert {tuple(r) for r in registry.QUERIES["di04_first_kept"](spark, sf).collect()} == want


def test_greedy_match_of_all_rows(spark, tmp_path):
    rows = [(1, 10, 1, 5.0, "R"), (1, 11, 1, 6.0, "A"), (1, 9000, 1, 20.0, "R"), (1, 9001, 1, 22.0, "A"), (1, 9002, 1, 21.0, "R")]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(tuple(r) for r in registry.QUERIES["jn19_greedy_match"](spark, str(tmp_path)).collect()) == [(1, 10, 11), (1, 9002, 9001)]


def test_containment_and_insert_reach_late_keys(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "s_suppkey long, x int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 9000, 1, 5.0)], "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(500,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(500,), (900,)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.section for r in registry.QUERIES["jn14_containment"](spark, str(tmp_path)).collect()} == {9000}
    assert sorted(r.k for r in registry.QUERIES["snk05_insert_absent"](spark, str(tmp_path)).collect()) == [500, 900]


def test_reports_and_overlaps_leave_no_key_out(spark, sf):
    from wellframe.plans import reports

    assert reports.field(registry.Tables(spark, sf))["events"].count() == len(lines(spark, sf))
    for name in ("jn16_overlap", "jn17_best_overlap"):
        assert {r.k % 10 for r in registry.QUERIES[name](spark, sf).collect()} == set(range(10))


def test_limit_is_for_each_well(spark):
    from wellframe.operators import wells

    offsets = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "wellbore_id string, other_id string, surface_m double")
    events = spark.createDataFrame([("x", f"e{i}", float(i), "approved") for i in range(5)], "wellbore_id string, event_id string, md_from_m double, review_status string")
    got = [(r.wellbore_id, r.event_id) for r in wells.events_for_offsets(offsets, events, limit=2).collect()]
    assert got == [("a", "e0"), ("a", "e1"), ("b", "e0"), ("b", "e1")]


def test_snippets_of_every_length(spark, tmp_path):
    texts = {1: "  the quick brown fox jumps over the lazy dog", 2: "one\ttwo  three four", 3: "word", 4: "", 5: None, 6: "upquick brown foxes jump, over it"}
    snippets = ["quick", "ick bro", "uick brown fo", "ick brown fox jum", "quick brown fox jumps over", "wo  three", "two three", "ord", "", " ", "q", "ick brown foxes jump, ov", None]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(snippets)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i) for d, x in texts.items() for i, s in enumerate(snippets) if x is not None and s is not None and s in x}
    got = [tuple(r) for r in registry.QUERIES["jn25_containment"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_first_kept_has_tasks_by_rows(spark, monkeypatch):
    """what one task sorts doesn't grow with the table."""
    from wellframe.operators import dedup, stages

    monkeypatch.setattr(stages, "TASK_ROWS", 50)
    df = spark.range(1000).selectExpr("id % 200 AS k", "double(id % 7) AS v", "id AS o")
    out = dedup.first_kept(df, ["k"], "v", ["o"], 5.0)
    assert out.rdd.getNumPartitions() == 20 and out.count() == len({(r.k, r.o) for r in out.collect()}) >= 200
