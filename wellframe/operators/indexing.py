"""The chunk index of documents: chunks tagged with formation and depths, rebuilt only where a document's pages changed.

Inputs: pages (doc_id, page, text), entities (doc_id, page, ord, snippet, formation, md_from_m, md_to_m: events in order, then
formation tops, which have no snippet), and aliases of formations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.functions import fuzzy, units
from wellframe.functions import text as tx
from wellframe.operators.stages import dealt

# The snippet length from which a near match counts, how near, and the depths in metres that a text may name.
MIN_SNIPPET, NEAR = 20, 90.0
MIN_DEPTH, MAX_DEPTH = 1.0, 12_000.0
#: Characters of all aliases together: they are one pattern.
MAX_ALIAS_CHARS = 200_000


@dataclass(frozen=True)
class Aliases:
    """All aliases of a dictionary as one pattern of whole words, the longest first, and what each one means."""

    meaning: dict[str, str]

    @classmethod
    def of(cls, synonyms: dict[str, str]) -> Aliases:
        meaning = {" ".join(a.lower().split()): f for a, f in synonyms.items() if a.strip()}
        if sum(map(len, meaning)) > MAX_ALIAS_CHARS:
            raise ValueError(f"aliases of more than {MAX_ALIAS_CHARS} characters")
        return cls(meaning)

    def found(self, text: Column) -> Column:
        """The formations named in a text, each once, in the order of their first mention."""
        if not self.meaning:
            return F.array().cast("array<string>")
        names = sorted(self.meaning, key=lambda a: (-len(a), a))
        pattern = r"(?iU)(?<!\w)(?:" + "|".join(r"\s+".join(map(_literal, a.split())) for a in names) + r")(?!\w)"
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        known = F.create_map(*[F.lit(x) for pair in self.meaning.items() for x in pair])
        return F.array_distinct(F.filter(F.transform(hits, lambda h: F.try_element_at(known, tx.squash(h))), lambda f: f.isNotNull()))


def _literal(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def text_depths(text: Column) -> Column:
    """The depths in metres that a text names with a unit."""
    of_length = F.filter(units.quantities(text), lambda q: (q.unit_si == "m") & q.value_si.between(MIN_DEPTH, MAX_DEPTH))
    return F.transform(of_length, lambda q: q.value_si)


def tagged(chunks: DataFrame, entities: DataFrame, aliases: Aliases) -> DataFrame:
    """``chunks`` (doc_id, page, chunk_no, chunk) with formation, md_from_m, md_to_m.

    An entity of the page belongs to a chunk that holds its snippet, nearly so if the snippet is long enough, or, without
    one, that names its formation.  The first one's formation and all their depths are the chunk's; else what its text names.
    """
    named = chunks.withColumn("_named", aliases.found(F.col("chunk")))
    key = ["doc_id", "page", "chunk_no"]
    e = entities.select("doc_id", "page", "ord", tx.squash(F.coalesce("snippet", F.lit(""))).alias("_s"), F.col("formation").alias("_f"), F.array_compact(F.array("md_from_m", "md_to_m")).alias("_d"))
    both = dealt(named.select(*key, "chunk", "_named"), ["doc_id", "page"]).join(dealt(e, ["doc_id", "page"]), ["doc_id", "page"])
    near = F.when(F.length("_s") >= MIN_SNIPPET, F.col("_s"))
    held = F.when(F.col("_s") == "", F.array_contains("_named", F.col("_f"))).otherwise(F.contains(tx.squash(F.col("chunk")), F.col("_s")) | (F.coalesce(fuzzy.snippet_ratio(near, F.col("chunk"), NEAR), F.lit(0.0)) >= NEAR))
    of = both.where(F.coalesce(held, F.lit(False))).groupBy(*key).agg(F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("ord"))).alias("_f"), F.flatten(F.collect_list("_d")).alias("_d"))
    out = named.join(of, key, "left")
    depths = F.when(F.size(F.coalesce("_d", F.array())) > 0, F.col("_d")).otherwise(text_depths(F.col("chunk")))
    out = out.withColumns({"formation": F.coalesce("_f", F.try_element_at("_named", F.lit(1))), "_d": depths})
    return out.select(*chunks.columns, "formation", F.array_min("_d").alias("md_from_m"), F.array_max("_d").alias("md_to_m"))


def content_hashes(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, content_hash: of all that a document's chunks depend on, summed up without bringing its pages together."""
    part = lambda df, kind, cols: df.select("doc_id", F.xxhash64(F.lit(kind), *cols).alias("a"), F.xxhash64(*cols, F.lit(kind)).alias("b"))
    parts = part(pages, "page", ["page", "text"]).unionByName(part(entities, "entity", ["page", "ord", "snippet", "formation", "md_from_m", "md_to_m"]))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = parts.groupBy("doc_id").agg(wide("a").alias("a"), wide("b").alias("b"), F.count("*").alias("n"))
    return sums.select("doc_id", F.sha2(F.concat_ws(":", "a", "b", "n"), 256).alias("content_hash"))


def build(pages: DataFrame, entities: DataFrame, aliases: Aliases, size: int = 1200, overlap: int = 200) -> DataFrame:
    """doc_id, page, chunk_no, chunk, formation, md_from_m, md_to_m, content_hash of every chunk of the pages."""
    each = tx.chunks(dealt(pages, ["doc_id", "page"]).select(F.struct("doc_id", "page").alias("at"), "text"), "at", "text", size, overlap)
    each = each.select("at.doc_id", "at.page", "chunk_no", "chunk")
    return tagged(each, entities, aliases).join(content_hashes(pages, entities), "doc_id")


def refreshed(index: DataFrame, pages: DataFrame, entities: DataFrame, aliases: Aliases) -> DataFrame:
    """The index after the pages and entities of today: documents whose content is the same keep their chunks, unread.

    Only hashes are compared; the pages of changed and new documents alone are chunked and tagged, and documents without pages go.
    """
    now = content_hashes(pages, entities).join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
    same = index.select("doc_id", "content_hash").distinct().join(now, ["doc_id", "content_hash"]).select("doc_id")
    todo = now.select("doc_id").join(same, "doc_id", "left_anti")
    mine = lambda df: df.join(todo, "doc_id", "left_semi")
    return index.join(same, "doc_id", "left_semi").unionByName(build(mine(pages), mine(entities), aliases).select(index.columns))
