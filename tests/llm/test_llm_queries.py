"""The registered queries: against their SQL, the libraries themselves, or held-out labels."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest

from wellframe.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    rel = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r)) for r in rel.fetchall())


def test_null_page_ids(spark, sf, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a"), (3, "u", "a"), (2, None, None), (5, "u", ""), (None, None, None)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((repr(r.page_id), r.record_type, r.refers_to) for r in queries.op1_warc_normalise(spark, str(tmp_path)).collect())
    assert got == sorted([("None", "revisit", 3), ("3", "response", None), ("2", "response", None), ("5", "revisit", 2), ("None", "revisit", 2)])


def test_bpe_digests_equal_the_library(spark, sf):
    import public_tokenizers as p
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("x", pat_str=p.PATTERN, mergeable_ranks=load_tiktoken_bpe(p.path(queries.RANKS)), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op4_bpe_roundtrip(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_shards_obey_their_law(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op6_hilbert_shards(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    slots = [sorted(r.slot for r in out if r.shard == s) for s in range(16)]
    assert sum(map(len, slots)) == len(texts) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert all(s == list(range(len(s))) for s in slots)


def test_toxicity_by_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op8_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [(toxic[r.doc_id], r.predicted) for r in out if r.held_out and toxic.get(r.doc_id) is not None]
    hit = sum(y and p for y, p in held)
    assert hit / sum(y for y, _ in held) >= 0.85 and hit / max(1, sum(p for _, p in held)) >= 0.9


def test_language_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_language_crf(spark, sf).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in out)
    held = [docs[r.doc_id].lang == r.lang_pred for r in out if r.held_out and docs[r.doc_id].lang is not None and docs[r.doc_id].text]
    assert np.mean(held) >= 0.95
