"""A corpus cleaned stage by stage: toxic documents, unknown languages, near-duplicates and benchmark leaks go.

Every stage works on all that its predecessor kept.  All but the last return the columns of ``documents``;
the last returns each kept document's digests of its token ids and of the bytes they decode to.
Documents with a null id are never dropped as duplicates.  Null texts have no toxic passage, are of unknown language
and so go in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.llm import langid, orderminhash, queries, toxicity, wumanber
from wellframe.llm.staging import staged

#: Documents of a higher toxicity go.
TOXIC = 0.3
#: Documents go in which no language holds this share of the words.
LANGUAGE_SHARE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose significant toxic segments score below the threshold."""
    return toxicity.keep_clean(docs, "text", queries.toxicity_model(spark, docs, sf_dir), TOXIC)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a prevailing language."""
    return langid.keep_known(docs, "text", queries.language_model(spark, docs), LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate class."""
    classes = orderminhash.near_duplicates(docs, "doc_id", "text")
    copies = staged(classes.where("doc_id <> class_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return wumanber.keep_clean(docs, "text", wumanber.load(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of what they decode to."""
    return queries.bpe_digests(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", tokenise),
]

#: The models and sketches of the first three stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
