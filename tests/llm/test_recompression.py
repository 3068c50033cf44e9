"""Repeated windows by recompression, against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wellframe.llm import queries, recompression


def plainly(rows, window):
    """{index of row: (n_words, removed positions, digest)} of (key, text) rows that are in order."""
    seen, out = set(), {}
    for i, (_, text) in enumerate(rows):
        w = (text or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    return out


def corpus(seed, docs, vocabulary, longest=300):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(vocabulary))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(r.choice([19, 20, 21, 35, 70, 200])) for _ in range(8)]
    out = []
    for _ in range(docs):
        kind = r.random()
        if kind < 0.3 and out:  # a near copy
            w = list(r.choice(out))
            for _ in range(r.randrange(4)):
                if w:
                    k = r.randrange(len(w))
                    w[k : k + r.randrange(2)] = text(r.randrange(3))
        elif kind < 0.4 and out:
            w = list(r.choice(out))
        elif kind < 0.5:  # one word or two over and over
            w = text(r.randrange(1, 3)) * r.randrange(60)
        else:
            w = text(r.randrange(longest))
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w) + 1)
                w[k:k] = r.choice(passages)
        out.append(w)
    space = lambda: r.choice([" ", "\n", " \t ", "\r\n"])
    return ["".join(x + space() for x in w) for w in out]


@pytest.mark.parametrize(("seed", "vocabulary", "window"), [(1, 5000, 20), (2, 40, 20), (3, 3, 20), (4, 5000, 5), (5, 2, 7), (6, 300, 40)])
def test_repeats_equal_all_windows(spark, seed, vocabulary, window):
    rows = list(enumerate(corpus(seed, 220, vocabulary)))
    shuffled = random.Random(seed).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(7)
    got = recompression.repeats(df, "doc_id", "text", window).collect()
    want = plainly(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert any(x[1] for x in want.values()) and any(x[1] == 0 for x in want.values())
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_signs_and_symbols_depend_on_content_alone():
    """A window's sign is the same in any text, and lies in it."""
    r = random.Random(8)
    for vocabulary in (2, 30, 10_000):
        shared = [f"v{r.randrange(vocabulary)}" for _ in range(60)]
        seen = []
        for _ in range(20):
            pad = lambda: [f"v{r.randrange(vocabulary)}" for _ in range(r.randrange(50))]  # noqa: B023, E731
            before = pad()
            t = pa.array(["other words", " ".join([*before, *shared, *pad()]), ""])
            [(_, _, words)] = recompression.texts(t)
            p = recompression.parse(words, 20)
            at = np.flatnonzero((p.start >= 2 + len(before)) & (p.start <= 2 + len(before) + 40))
            seen.append((p.sign_key[p.sign[at]].tolist(), (p.sign_at[at] - p.start[at]).tolist(), [x.tolist() for x in p.fingerprints(p.start[at])]))
            assert np.all(p.sign_at >= p.start)
        assert all(s == seen[0] for s in seen)


def test_query_equals_all_windows(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op12_substring_dedup(spark, sf).collect()}
    assert got == {rows[i][0]: v for i, v in plainly(rows, 20).items()}


def test_packed_often(spark, monkeypatch):
    monkeypatch.setattr(recompression, "PACKED", 500)
    sent = recompression.Sender(3)
    rng = np.random.default_rng(1)
    key, rid, code = rng.integers(0, 400, 3000).astype(np.uint64), np.sort(rng.integers(0, 50, 3000)), rng.permutation(3000).astype(np.uint32) * 4
    check = np.where(key % np.uint64(2) == 0, 0, 5).astype(np.uint32)
    batches = []
    for lo in range(0, 3000, 250):
        i = slice(lo, lo + 250)
        sent.add(key[i], check[i], rid[i], code[i])
        batches += sent.rows()
    batches += sent.rows(last=True)
    df = spark.createDataFrame(pa.Table.from_batches(batches)).selectExpr("bucket", "settled", "n", "packed")
    got = sorted((r.rid, c) for r in recompression.answered(df, 3).collect() for c in np.frombuffer(r.codes, np.uint32).tolist())
    first, count = {}, {}
    for k, r, c in zip(key.tolist(), rid.tolist(), code.tolist(), strict=True):
        first[k], count[k] = min(first.get(k, (r, c)), (r, c)), count.get(k, 0) + 1
    want = [(r, c) for k, r, c in zip(key.tolist(), rid.tolist(), code.tolist(), strict=True) if (count[k] > 1 if k % 2 == 0 else first[k] != (r, c))]
    assert got == sorted(want)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(None, "a " * 30, 1), (None, None, 1), (3, None, 2), (3, long, 2), (3, long, 2), (5, "", 3), (1, " \n\t", 3), (9, "a " * 30, 4), (2, "é b " * 25, 5)]
    df = spark.createDataFrame(rows, "id long, text string, spans int")
    got = recompression.repeats(df, "id", "text").collect()
    assert sorted((repr(r.id), r.n_words, r.n_removed) for r in got) == sorted([("None", 30, 30), ("None", 0, 0), ("3", 0, 0), ("3", 60000, 0), ("3", 60000, 60000), ("5", 0, 0), ("1", 0, 0), ("9", 30, 29), ("2", 25, 24)])
    assert recompression.repeats(df.limit(0), "id", "text").collect() == []
    one = spark.createDataFrame([("b", "x y " * 20), ("a", "x y " * 20)], "id string, text string")
    out = recompression.repeats(one, "id", "text")
    assert {r.id: r.n_removed for r in out.collect()} == {"a": 38, "b": 40}
    back = recompression.without(one.join(out.select("id", "spans"), "id"), "text", "spans").collect()
    assert {r.id: r.text for r in back} == {"a": "x y", "b": ""}
