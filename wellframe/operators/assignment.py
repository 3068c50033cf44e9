"""A reviewer's choice of a document's well, and the move of the document's records to it, for many documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.operators import aggregates

#: The new status of the field by action (fixed values).
STATUS = {"approve": "approved", "edit": "edited", "reject": "rejected"}


def decided(decisions: DataFrame, wells: DataFrame, wellbores: DataFrame) -> DataFrame:
    """seq, field_id, doc_id, action, result, new_status, well_id, wellbore_id of each decision.

    decisions: seq, field_id, doc_id, action, old_value, new_value (JSON: a well's id, or an object that has it as ``value``).  To approve takes
    the old value, to edit the new one, which must name a well; its wellbore is the primary one, the first by name, or null.
    A rejection changes nothing but the field.
    """
    raw = F.when(F.col("action") == "edit", F.col("new_value")).otherwise(F.col("old_value"))
    v = F.try_parse_json(raw)
    inner = F.coalesce(F.try_variant_get(v, "$.value", "string"), v.try_cast("string"))
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    chosen = F.when(is_object, F.try_variant_get(v, "$.value", "string")).otherwise(F.coalesce(inner, raw))
    x = decisions.withColumn("_well", F.nullif(F.when(F.col("action") != "reject", chosen), F.lit("")))
    known = wells.select(F.col("well_id").cast("string").alias("_well"), F.lit(True).alias("_known"))
    primary = aggregates.distinct_on(wellbores.where("is_primary"), ["well_id"], [F.col("name"), F.col("wellbore_id")]).select(F.col("well_id").cast("string").alias("_well"), "wellbore_id")
    x = x.join(known, "_well", "left").join(primary, "_well", "left")
    bad = F.when(~F.col("action").isin(*STATUS), "bad_action").when((F.col("action") == "edit") & F.col("new_value").isNull(), "value_required").when((F.col("action") != "reject") & F.col("_well").isNull(), "empty_value").when((F.col("action") != "reject") & F.col("_known").isNull(), "no_such_well")
    result = F.coalesce(bad, F.lit("ok"))
    ok = result == "ok"
    status = F.when(ok, F.create_map(*[F.lit(z) for pair in STATUS.items() for z in pair])[F.col("action")])
    return x.select("seq", "field_id", "doc_id", "action", result.alias("result"), status.alias("new_status"), F.when(ok, F.col("_well")).alias("well_id"), F.when(ok & (F.col("action") != "reject"), F.col("wellbore_id")).alias("wellbore_id"))


def moves(results: DataFrame) -> DataFrame:
    """doc_id, wellbore_id, seq: the last wellbore that each document was given."""
    some = results.where("result = 'ok' and wellbore_id is not null")
    return some.groupBy("doc_id").agg(F.max_by("wellbore_id", "seq").alias("_to"), F.max("seq").alias("_seq"))


def moved(records: DataFrame, to: DataFrame) -> DataFrame:
    """``records`` (doc_id, wellbore_id, ...) with the wellbore of their document's move; others, and those of no document, stay."""
    return records.join(to.select("doc_id", "_to"), "doc_id", "left").withColumn("wellbore_id", F.coalesce("_to", "wellbore_id")).select(records.columns)


def moved_tops(tops: DataFrame, to: DataFrame) -> DataFrame:
    """The same for tops (id, doc_id, wellbore_id, formation, source, ...), of which a wellbore has one for each formation and source.

    A top that would be a second one is dropped: tops that are there stay, of several that come the earliest decision's does.
    """
    x = tops.join(to, "doc_id", "left").withColumn("_comes", F.coalesce(F.col("_to") != F.col("wellbore_id"), F.lit(False)))
    x = x.withColumn("wellbore_id", F.coalesce("_to", "wellbore_id"))
    first = Window.partitionBy("wellbore_id", "formation", "source").orderBy("_comes", "_seq", "id")
    return x.withColumn("_r", F.row_number().over(first)).where("not _comes or _r = 1").select(tops.columns)
