"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.llm import bpe, curveknn, dialogue, infill, langid, notices, orderminhash, recompression, sharding, toxicity, urlrules, warc, wumanber
from wellframe.llm.staging import staged
from wellframe.llm.words import LOWER, UPPER, WORD_RE

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, normalised, and read back."""
    out = warc.round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_curve_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth one."""
    return curveknn.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "id % 20 = 0", k=20)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return orderminhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


def bpe_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Ids of every document's whole text and the bytes they decode to, as digests."""
    import public_tokenizers

    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.round_trip(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe_digests(spark, _table(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the longest rule that fits."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.filter_urls(_table(spark, sf_dir, "pages"), "page_id", "url", rules)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot on the Hilbert curve of source, language, length and id."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang", "n_chars", "doc_id"], shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_notice_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return notices.scan(_table(spark, sf_dir, "documents"), "doc_id", "text").drop("matches")


#: Rows whose labels may be learned: those of the other remainder are held out.
HELD_OUT = 2


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == HELD_OUT


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Broadcast:
    """Learned from ``docs`` and the labels, without the rows held out."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out("_key"))
    return spark.sparkContext.broadcast(model)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, "doc_id", "text", toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def language_model(spark: SparkSession, docs: DataFrame) -> Broadcast:
    """Learned from the texts of known language, without the rows held out."""
    return spark.sparkContext.broadcast(langid.train(docs, "text", "lang", ~held_out("doc_id")))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, "doc_id", "text", language_model(spark, docs))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows."""
    patterns = wumanber.load(_table(spark, sf_dir, "benchmark"), "item_id", "text")
    out = wumanber.scan(_table(spark, sf_dir, "documents"), "doc_id", "text", patterns)
    ids = F.array_join(F.array_sort("items"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two lines, its middle moved to the end, and put together again."""
    out = infill.transform(_table(spark, sf_dir, "documents"), "doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that repeat earlier ones in windows of 20."""
    return recompression.repeats(_table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: by a checksum of id and turn, rows are dropped, emptied, cut short, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    out = rows.where(draw != 0).select("conv_id", "turn", F.when(draw == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(draw == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults and its cheapest repair."""
    table = _table(spark, sf_dir, "conversations")
    rows, names = damaged(table), ("conv_id", "turn", "role", "text")
    audits = staged(dialogue.parsed(rows, *names), "audits")
    digests = dialogue.digests(dialogue.repaired(rows, *names, audits), "conv_id").withColumnRenamed("conv_id", "d")
    ids = table.select(F.col("conv_id").alias("c")).distinct()
    out = ids.join(audits, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(digests, F.col("c").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_warc_normalise": op1_warc_normalise,
    "op2_curve_knn": op2_curve_knn,
    "op3_order_minhash": op3_order_minhash,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_url_rules": op5_url_rules,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_notice_scan": op7_notice_scan,
    "op8_toxicity": op8_toxicity,
    "op9_language_crf": op9_language_crf,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

#: A text's words in DuckDB.
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE}')"

_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
_PATH = r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

#: SHA-1 in base32: every five hexadecimal digits are four characters.
_B32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '')"

_OP10 = f"""
        WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        dw AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS s
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
        f AS (SELECT doc_id, k, dw.m, item_id FROM dw JOIN bw USING (m, s)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM f) GROUP BY 1),
        i AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM f GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
               sha256(coalesce(i.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

#: The k-th group of eight digits of a document's draw.
_DRAW = lambda k: f"('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {8 * k - 7}, 8))::BIGINT"

_OP11 = f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, {_DRAW(1)} AS h1, {_DRAW(2)} AS h2, {_DRAW(4)} AS h4 FROM documents),
        c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p"""

ORACLES = {
    "op11_fill_in_middle": _OP11,
    "op10_decontaminate": _OP10,
    "op1_warc_normalise": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
        SELECT page_id, payload_bytes, {_B32} AS payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM g""",
    "op5_url_rules": f"""
        WITH rules(rh, rp, rv) AS (VALUES {_RULES}),
        u AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
        j AS (SELECT page_id, host, path, rh || rp AS rule, rv,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC, rv DESC) AS k
              FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM j WHERE k = 1""",
}
