"""Toxicity learned from few distinct texts with many copies."""

import pytest

from wellframe.llm import queries, toxicity

CLEAN = ["the river runs past the old mill", "bread and salt on a wooden table", "rain fell over the quiet harbour all day", "a train left the station at noon", "green hills under a pale sky"]
TOXIC = ["you are a wretched fool and a liar", "what a stupid worthless coward", "shut up you filthy rat", "idiot nobody wants you here", "go away you miserable scum"]


def table(spark, folder, rows):
    """Documents and labels of (text, toxic or None) rows, in Spark: ids count up."""
    from pyspark.sql import functions as F

    kinds = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "k int, text string, toxic int")
    n = len(rows)
    ids = spark.range(20_000).withColumn("k", (F.col("id") % n).cast("int"))
    both = ids.join(kinds, "k").select(F.col("id").alias("doc_id"), "text", "toxic")
    both.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{folder}/documents.parquet")
    both.select("doc_id", F.lit(1).alias("quality"), "toxic").where("toxic is not null").write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("n", [1, 2, 5])
def test_copies_of_each_class(spark, tmp_path, n):
    rows = [(t, 1) for t in TOXIC[:n]] + [(t, 0) for t in CLEAN[:n]]
    table(spark, tmp_path, rows)
    out = queries.op8_toxicity(spark, str(tmp_path))
    got = {(r.text, r.predicted): r["count"] for r in out.join(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id").groupBy("text", "predicted").count().collect()}
    assert set(got) == {(t, y) for t, y in rows} and sum(got.values()) == 20_000


def test_uneven_copies(spark, tmp_path):
    table(spark, tmp_path, [(TOXIC[0], 1)] + [(CLEAN[0], 0)] * 60 + [(CLEAN[1], 0)])
    out = queries.op8_toxicity(spark, str(tmp_path)).join(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id")
    assert {(r.text, r.predicted) for r in out.select("text", "predicted").distinct().collect()} == {(TOXIC[0], 1), (CLEAN[0], 0), (CLEAN[1], 0)}


@pytest.mark.parametrize("rows", [[(TOXIC[0], 1)], [(CLEAN[0], 0), (CLEAN[1], 0)], [(TOXIC[0], None)], [(None, 1), ("", 0)], [(None, 1), (CLEAN[0], 0)]])
def test_one_class_or_none(spark, tmp_path, rows):
    table(spark, tmp_path, rows)
    out = queries.op8_toxicity(spark, str(tmp_path))
    assert {(r.score, r.predicted) for r in out.select("score", "predicted").distinct().collect()} == {(0.0, 0)}
    assert out.count() == 20_000


def test_one_text_of_both_classes(spark):
    docs = spark.createDataFrame([(i, TOXIC[0]) for i in range(400)], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "id long, toxic int")
    model = toxicity.train(docs, labels, "id", "text", "toxic")
    [got] = {r.score for r in toxicity.score(docs, "id", "text", spark.sparkContext.broadcast(model)).collect()}
    assert 0.3 < got < 0.7
