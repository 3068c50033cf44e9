"""Decontamination, notices, toxicity and language: against brute force and held-out labels."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_words_and_codes import plain_words
from wellframe.llm import langid, notices, queries, toxicity, wumanber
from wellframe.llm.words import blocks


def plain_hits(text, items, window):
    w = plain_words(text)
    hit, found = set(), set()
    for ident, t in items:
        p = plain_words(t)
        m = min(window, len(p))
        grams = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in grams:
                hit.update(range(i, i + m))
                found.add(ident)
    return len(w), len(hit), found


text = st.lists(st.sampled_from(["a", "b", "A", "é", "c d", ".", "-"]), max_size=40).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=5), st.lists(st.tuples(st.sampled_from(["1", "2", "10", None]), st.one_of(st.none(), text)), max_size=4), st.integers(1, 6))
def test_wu_manber_equals_brute_force(docs, items, window):
    got = [(n, sum(b - a for a, b in runs), found) for n, runs, found in wumanber.hits(pa.array(docs, pa.string()), wumanber.build(items, window))]
    assert got == [plain_hits(d, items, window) for d in docs]


def test_decontamination_frame(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (3, ""), (None, "nameless item here")]
    docs = [(1, "x One two-three four five six seven eight nine ten y", "c"), (2, "a SHORT item short item", "c"), (3, None, "c"), (4, "", None), (4, "nameless item here", "c"), (5, "one two three four five six seven eight nine", "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (500_000, 5):  # one block, and one block for each item
        patterns = wumanber.load(b, "item_id", "text", max_words=size)
        out = wumanber.scan(d, "doc_id", "text", patterns).collect()
        assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out] == [(1, 12, 10, ["1"]), (2, 5, 4, ["2"]), (3, 0, 0, []), (4, 0, 0, []), (4, 3, 3, []), (5, 9, 0, [])]
        assert out[1].spans == [[1, 5]]
        kept = wumanber.keep_clean(d, "text", patterns)
        assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [3, 4, 5]
    assert wumanber.scan(d, "doc_id", "text", wumanber.load(b.limit(0), "item_id", "text")).where("n_hit > 0").count() == 0
    assert wumanber.scan(d.limit(0), "doc_id", "text", patterns).count() == 0


def plain_base(t):
    w, out = plain_words(t), []
    for phrase, label in notices.BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return out


def test_notices(spark):
    texts = ["Under the MIT License; under the mit-license!", "Licensed undr the Apache Licence, Version 2.0", "Licensed under the Apache License, Version 1.1", "relaesed under the MIT License", None, "", "CC BY-NC 4.0, cc by nc", "This work is licensed under the GNU General Public License, version 3.", "nothing of the kind " * 400 + "gnu lesser genral public license", "under the mit"]
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = {r.doc_id: r for r in notices.scan(d, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        base, r = plain_base(t), out[i]
        assert (r.n_words, r.n_base) == (len(plain_words(t)), len(base))
        assert (r.first_word, r.last_word) == (min((x for x, _ in base), default=None), max((x for x, _ in base), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        for m in r.matches:
            assert plain_words(t)[m.first_word : m.end_word] == plain_words(t.encode()[m.start : m.end].decode())
    assert out[1].labels == "apache-2" and out[1].n_base == 0 and 0.8 < out[1].score < 1
    assert out[2].labels == "" and out[3].labels == "mit" and out[7].labels == "gpl" and out[8].labels == "lgpl"
    assert notices.scan(d.limit(0), "doc_id", "text").count() == 0


def test_fuzzy_notices_equal_plain_search():
    """Every place within the allowed edits is found: seeds lose none."""
    import regex

    rng = np.random.default_rng(1)
    s = notices.Scanner(notices.NOTICES, notices.BASE_PHRASES)
    for label, fuzzy, tail in notices.NOTICES:
        k = max(1, len(fuzzy) // notices.CHARS_PER_EDIT)
        for _ in range(6):
            t = list(fuzzy)
            for _ in range(int(rng.integers(0, k + 1))):
                at = int(rng.integers(0, len(t)))
                t[at] = str(rng.choice(["", "q", t[at] + "z"]))
            t = "aaa " + "".join(t) + tail + " bbb"
            want = regex.search(f"(?<![^ ])(?:{regex.escape(fuzzy)}){{e<={k}}}{regex.escape(tail)}(?![^ ])", " ".join(plain_words(t)))
            got = s.fuzzy(next(blocks(pa.array([t])))[2]).get(0, [])
            assert (want is not None) == any(g[0] == label for g in got), t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    """By definition: repeatedly take the best-scoring segment (the shortest such) and split around it."""

    def plain(lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                v = sum(scores[a:b])
                if v > 0 and (best is None or (v, a - b) > (best[2], best[0] - best[1])):
                    best = (a, b, v)
        return plain(lo, best[0]) + [best] + plain(best[1], hi) if best else []

    got = toxicity.segments(np.array(scores, dtype=float))
    assert [v for _, _, v in got] == [v for _, _, v in plain(0, len(scores))]


def test_toxicity_learns_and_keeps_clean(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocab, 60))
        toxic = int(i % 6 == 0)
        if toxic:
            w[10], w[11] = "vileword", "nastier" + str(i)
        rows.append((i, " ".join(w), "c"))
        labels.append((i, toxic))
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, "nastierunseen form", "c"), (1002, "plain", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, toxic int")
    model = toxicity.train(d, marks, "doc_id", "text", "toxic", ~queries.held_out("_key"))
    out = {r.doc_id: r for r in toxicity.score(d, "doc_id", "text", spark.sparkContext.broadcast(model)).collect() if r.doc_id < 1000}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((out[i].score >= 0.3) == bool(i % 6 == 0) for i in held)
    assert all(s.first_word <= 11 and s.end_word >= 11 and s.evalue < 0.05 for i in held if i % 6 == 0 for s in out[i].segments[:1])
    kept = toxicity.keep_clean(d, "text", spark.sparkContext.broadcast(model), 0.3)
    assert kept.columns == d.columns and kept.count() == 500 + 3
    none = toxicity.train(d, marks.limit(0), "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.score(d, "doc_id", "text", spark.sparkContext.broadcast(none)).collect()} == {0.0}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    m, sizes = 3, [1, 5, 0, 70, 33, 32, 64]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, a = rng.normal(size=(first[-1], m)), rng.normal(size=(m, m))
    post, pairs = langid.marginals(e, first, a)
    want, counts = [], np.zeros((m, m))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        n, psi, t = hi - lo, np.exp(e[lo:hi]), np.exp(a)
        if not n:
            continue
        f, b = [psi[0]], [np.ones(m)]
        for k in range(1, n):
            f.append((f[-1] @ t) * psi[k])
            f[-1] = f[-1] / f[-1].sum()
        for k in range(n - 2, -1, -1):
            b.append(t @ (psi[k + 1] * b[-1]))
            b[-1] = b[-1] / b[-1].sum()
        b = b[::-1]
        q = np.array(f) * np.array(b)
        want.append(q / q.sum(axis=1, keepdims=True))
        for k in range(1, n):
            j = f[k - 1][:, None] * t * (psi[k] * b[k])[None]
            counts += j / j.sum()
    assert np.allclose(post, np.concatenate(want), atol=1e-6) and np.allclose(pairs, counts, atol=1e-5)


def test_language_of_words_and_texts(spark):
    rng = np.random.default_rng(0)
    parts = {"aa": ["bra", "kol", "ti"], "bb": ["zu", "mee", "ixo"]}
    make = lambda x, n: " ".join("".join(rng.choice(parts[x], 3)) for _ in range(n))
    train = [(i, make(x, 40), x) for i, x in enumerate(["aa", "bb"] * 40)]
    d = spark.createDataFrame([*train, (900, "never", None)], "doc_id long, text string, lang string")
    model = langid.train(d, "text", "lang", ~queries.held_out("doc_id"))
    texts = [make("aa", 30), make("bb", 30), make("aa", 20) + " " + make("bb", 12), None, "", "12 34 ...", "Ω", "日本"]
    t = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)], "doc_id long, text string, lang_pred string")
    b = spark.sparkContext.broadcast(model)
    out = {r.doc_id: r for r in langid.predict(t, "doc_id", "text", b, detail=True).collect()}
    assert [out[i].lang_pred for i in range(6)] == ["aa", "bb", "aa", "und", "und", "und"]
    assert out[6].lang_pred in parts and out[7].lang_pred in parts and all(0 <= r.score <= 1 for r in out.values())
    runs = out[2].runs
    assert runs[0].label == "aa" and runs[-1].label == "bb" and abs(runs[-1].first_word - 20) <= 1
    assert langid.keep_known(t, "text", b).columns == t.columns
    nothing = spark.sparkContext.broadcast(langid.train(d.limit(0), "text", "lang"))
    assert {r.lang_pred for r in langid.predict(t, "doc_id", "text", nothing).collect()} == {"und"}


def test_held_out_rows_by_crc(spark):
    rows = spark.range(50).select("id", queries.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language_crf(spark, sf).where("held_out").collect()
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in got]) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.predicted for r in queries.op8_toxicity(spark, sf).where("held_out").collect() if r.doc_id in toxic}
    assert np.mean([toxic[i] == p for i, p in got.items()]) > 0.9
    assert math.isclose(len(docs), queries.op7_notice_scan(spark, sf).count())
    assert re.fullmatch("[0-9a-f]{64}", queries.op10_decontaminate(spark, sf).first().items_sha256)


def test_copies_do_not_push_a_language_out(spark):
    from wellframe.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")
    copies = spark.range(20_000).select(F.lit("la maison est sur la colline et le chat dort").alias("text"), F.lit("fr").alias("lang"))
    model = langid.train(docs.unionByName(copies), "text", "lang", docs_per_label=40, epochs=1)
    assert set(model.labels) == {r.lang for r in docs.where("lang is not null").distinct().collect()}
    long = spark.createDataFrame([("alpha beta " * 6000, "xx"), ("gamma delta", "yy")], "text string, lang string")
    assert langid.train(long, "text", "lang", epochs=1).labels == ["xx", "yy"]


def test_blocks_of_a_benchmark_are_bounded(spark):
    """Copies in number, in one task or not: no block exceeds its bound, and together they find what one block finds."""
    items = [(i, f"word{i % 40} a b c") for i in range(400)] + [(7, "same same") for _ in range(300)] + [(None, None)]
    b = spark.createDataFrame(items, "item_id int, text string").repartition(1)
    small, whole = wumanber.load(b, "item_id", "text", max_words=100), wumanber.load(b, "item_id", "text")
    assert len(whole) == 1 and len(small) > 10
    assert all(sum(t.length * len(t.texts) for t in p.value.tables) <= 100 for p in small)
    d = spark.createDataFrame([(i, f"x word{i} A b c y same same") for i in range(50)], "doc_id long, text string")
    a, z = (wumanber.scan(d, "doc_id", "text", p).collect() for p in (small, whole))
    assert a == z and [r.n_hit for r in z] == [6] * 40 + [2] * 10
