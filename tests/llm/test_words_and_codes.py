"""Words, Hilbert index, BPE, WARC, sharding, URL rules: against plain versions of the same."""

import base64
import gzip
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellframe.llm import bpe, sharding, urlrules, warc
from wellframe.llm.hilbert import hilbert_index
from wellframe.llm.words import LOWER, UPPER, WORD_RE, blocks, word_hash

TABLE = str.maketrans(UPPER, LOWER)


def plain_words(text):
    return re.findall(WORD_RE, (text or "").translate(TABLE))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.integers(1, 60))
def test_words_equal_the_pattern(texts, size):
    got = []
    for lo, hi, w in blocks(pa.array(texts, pa.string()), size):
        h = w.hashes() if len(w) else []
        for i in range(hi - lo):
            ks = range(w.first[i], w.first[i + 1])
            got.append([w.text(k).decode() for k in ks])
            assert list(word_hash([w.text(k) for k in ks])) == [h[k] for k in ks]
    assert got == [plain_words(t) for t in texts]


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_hilbert_visits_neighbours(d, bits):
    pts = np.array(list(itertools.product(range(2**bits), repeat=d)))
    h = hilbert_index(pts, bits)
    assert sorted(h) == list(range(len(pts)))
    assert (np.abs(np.diff(pts[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as p

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Codec(f.read(), p.PATTERN)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1'sé \n\t.日"), max_size=120), st.integers(1, 20))
def test_pieces_have_the_ids_of_the_whole(codec, text, size):
    whole = codec._enc.encode_ordinary(text)
    assert np.frombuffer(codec.encode(text, size), "<u4").tolist() == whole
    assert codec.decode(codec.encode(text, size)) == text.encode()


def test_bpe_frame(spark, codec):
    import public_tokenizers as p

    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello <|endoftext|> wörld " * 9000, None), (3, "dup", "z"), (None, "k", "z")]
    df = spark.createDataFrame(rows, "id long, text string, n_tokens string")
    ranks = bpe.load_ranks(spark, p.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe.decode(bpe.encode(df, "id", "text", ranks, p.PATTERN), "ids", ranks, p.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for _, t, _ in rows]
    assert [r.n_tokens for r in out] == [len(codec._enc.encode_ordinary(t or "")) for _, t, _ in rows]
    assert bpe.encode(df.limit(0), "id", "text", ranks, p.PATTERN).count() == 0


def test_warc_stream_parts():
    recs = [warc.record("response", str(i), "http://a/\n", "D", n, b"x\r\n\r\n" * n, None, "2024") for i, n in enumerate((0, 1, 5000))]
    whole = gzip.compress(b"".join(recs))
    for size in (1, 7, 1000, 1 << 20):
        chunks = (whole[i : i + size] for i in range(0, len(whole), size))
        assert list(warc.split_records(warc.inflate(chunks))) == recs
    many = b"".join(gzip.compress(r) for r in recs)
    assert list(warc.split_records(warc.inflate(iter([many])))) == recs
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(iter([whole[:-20]]))))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([recs[2][:-9]])))


def test_warc_round_trip(spark, tmp_path):
    html = ["same", "same", None, "", "é" * 3000, "same", "one"]
    rows = [(i, f"http://h/{i}" if i else None, h, "c") for i, h in enumerate(html)] + [(1, "http://h/1", "same", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    out = {}
    for r in warc.round_trip(df, "page_id", "url", "html", max_bytes=600).collect():
        out.setdefault(int(r.record_id), []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        for r in out[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", str(first)))
            assert r.payload is None or bytes(r.payload) == data
    assert warc.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_warc_odd_keys(spark):
    rows = [(None, "a"), ("", "a"), ("k 1/é\r\nX: y", "a"), ("z", "b"), ("z", "b"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "k string, p string").withColumn("u", F.lit("u"))
    got = sorted((repr(r.record_id), r.record_type, repr(r.refers_to)) for r in warc.round_trip(df, "k", "u", "p").collect())
    want = [(None, "revisit", ""), ("", "response", None), (rows[2][0], "revisit", ""), ("z", "response", None), ("z", "response", None), (None, "response", None), (None, "response", None)]
    assert got == sorted((repr(k), t, repr(f)) for k, t, f in want)


def test_warc_smallest_payload(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "k long, u string, p string")
    got = {int(r.record_id): r.record_type for r in warc.round_trip(df, "k", "u", "p", min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_shards_partition_all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(docs, "doc_id", "text", ["source", "lang", "n_chars", "doc_id"], shards=16).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode()))
    counts = np.bincount([r.shard for r in rows], minlength=16)
    assert counts.max() - counts.min() <= 1
    for s in range(16):
        own = sorted((r.slot, r.curve) for r in rows if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own)))
        assert [c for _, c in own] == sorted(c for _, c in own)


def test_shards_edge_cases_and_pruning(spark, tmp_path):
    rows = [(None, None, None, None), (1, "a", "en", 5), (1, "a", "en", 5), (2, "", None, 7), (3, "é", "de", None)]
    df = spark.createDataFrame(rows, "id long, text string, shard string, n long")
    out = sharding.shard(df, "id", "text", ["shard", "n"], shards=3).collect()
    assert len(out) == 5 and len({(r.shard, r.slot) for r in out}) == 5
    assert sharding.shard(df.limit(0), "id", "text", ["shard", "n"]).count() == 0
    wide = spark.range(4096).selectExpr("id", "cast(id % 64 as double) x", "cast(id div 64 as double) y", "'t' text")
    at = wide.join(sharding.shard(wide, "id", "text", ["x", "y"], shards=16), "id")
    table = sharding.pruning_table(at, "shard", ["x", "y"])
    assert sharding.prune(table, x=(0, 3), y=(0, 3)).count() <= 3
    assert sharding.prune(table, x=(0, 3)).count() <= 8
    sharding.write_shards(at, "shard", ["slot"], f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 4096


def test_shards_of_strings_with_a_long_common_prefix(spark):
    wide = spark.range(4096).selectExpr("id", "concat('https://www.example.org/', lpad(id % 64, 3, '0')) x", "cast(id div 64 as double) y", "'t' text")
    at = wide.join(sharding.shard(wide, "id", "text", ["x", "y"], shards=16), "id")
    table = sharding.pruning_table(at, "shard", ["x", "y"])
    assert sharding.prune(table, x=("https://www.example.org/000", "https://www.example.org/003")).count() <= 8


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(TABLE), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_rules_equal_brute_force(spark):
    rules = [("org", "/", "allow"), ("a.org", "/es/", "block"), ("b.a.org", "/es/", "allow"), ("a.org", "/e", "allow"), ("a.org", "/e", "block"), ("", "/any", "block"), ("com", "", "block"), ("x.com", "/p/q", "allow"), ("x.com", "/p", "block")]
    hosts = ["org", "a.org", "A.org", "b.a.org", "c.b.a.org", "aa.org", "com", "x.com", "y.x.com", "net", ""]
    paths = ["", "/", "/es/1", "/e", "/any", "/p", "/p/q?x", "/p/r#y", "?q", "#f://z"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nourl", "http://\u00e9.org/es/", "a://b://c"]
    urls += ["http://hot.a.org/es/"] * 60
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in urlrules.filter_urls(df, "page_id", "url", frame, ranges=5).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        h, p = plain_host_path(u)
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0]) or not r[0]) and p.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]), len(r[1]), r[2] == "block"), default=None)
        want = (h, p, best and best[0] + best[1], best[2] if best else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, u
    assert urlrules.filter_urls(df.limit(0), "page_id", "url", frame).count() == 0
    assert {r.verdict for r in urlrules.filter_urls(df, "page_id", "url", frame.limit(0)).collect()} == {"allow"}
