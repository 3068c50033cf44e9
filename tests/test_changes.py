"""Changes between snapshots, subscribers' filters, and the keyed view as a stream with a restart."""

import random

import pytest

from wellframe.streaming import changes


def test_changes_between_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (None, "n", 0.0)], "k int, s string, v double")
    new = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", 2.0, None), (4, "d", 4.0, None), (None, "m", 0.0, None)], "k int, s string, v double, extra string")
    got = {r.k: (r.op, r.old and r.old.v, r.new and r.new.v, r.new and r.new.extra) for r in changes.changes(old, new, ["k"]).collect()}
    assert got == {1: ("update", 1.0, 1.0, "x"), 2: ("update", None, 2.0, None), 3: ("delete", 3.0, None, None), 4: ("insert", None, 4.0, None), None: ("update", 0.0, 0.0, None)}
    assert changes.changes(old, old, ["k"]).collect() == []


CASES = {None: "abcd", "": "abcd", "nonsense": "abcd", "v=eq.2": "b", "v=neq.2": "ad", 'v=in.(1,"3")': "ad", "v=in.()": "", "v=gt.1": "bd", "v=gte.2": "bd", "v=lt.3": "ab", "v=lte.1": "a", "v=gt.x": "", "nope=eq.1": "", "s=eq.a": "a"}


@pytest.mark.parametrize("text", list(CASES))
def test_filters(spark, text):
    rows = [("a", 1), ("b", 2), ("c", None), ("d", 3)]
    empty = spark.createDataFrame([], "s string, v int")
    feed = changes.changes(empty, spark.createDataFrame(rows, "s string, v int"), ["s"])
    assert "".join(sorted(r.s for r in changes.subscribed(feed, text).collect())) == CASES[text]
    gone = changes.changes(spark.createDataFrame(rows, "s string, v int"), empty, ["s"])
    assert "".join(sorted(r.s for r in changes.subscribed(gone, text).collect())) == CASES[text]


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    schema = "k string, seq long, op string, new struct<v:int>"
    rows = [(r.choice("abcdef"), i, r.choice(["insert", "update", "update", "delete"]), (i,)) for i in range(120)]
    parts = [rows[:50], rows[40:90], rows[80:]]  # deliveries overlap
    r.shuffle(parts[1])
    view = {}

    def keep(df, _):
        for x in df.collect():
            view[x.k] = x

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = changes.view(feed, ["k"]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()  # each part is a new run on the same state
        want = {x.k: (x.seq, x.new.v) for x in changes.latest(spark.createDataFrame([y for p in parts[: i + 1] for y in p], schema), ["k"]).collect()}
        assert {k: (x.seq, x.new.v) for k, x in view.items() if x.op != "delete"} == want
