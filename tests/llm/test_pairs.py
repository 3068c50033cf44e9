"""Near-duplicates, components, neighbours and the pipeline: against brute force on small tables."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_words_and_codes import plain_words
from wellframe.llm import curveknn, orderminhash
from wellframe.llm.components import components, joined
from wellframe.llm.staging import only
from wellframe.llm.words import blocks


def plain_edits(a, b):
    """By the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def whole_edits(a, b):
    """As the table, a whole column at a time as bit vectors, for long texts."""
    where = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    n, full = len(a), (1 << len(a)) - 1
    up, down, cost = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        d = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = (down | ~(d | up)) & full, d & up
        cost += (rise >> (n - 1) & 1) - (fall >> (n - 1) & 1) if n else 1
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = (fall | ~(d | rise)) & full, d & rise
    return cost


def plain_similarity(a, b):
    return 1 - whole_edits(a, b) / max(len(a), len(b), 1) if a and b else 0.0


def similar_pairs(words, least=0.8):
    """All pairs of texts (id: words) of edit similarity ``least``; word counts refuse most before they are aligned."""
    ids = sorted(i for i in words if words[i])
    bins = np.array([np.bincount([zlib.crc32(x.encode()) % 1024 for x in words[i]], minlength=1024) for i in ids])
    n = bins.sum(axis=1)
    for k, i in enumerate(ids):
        d = bins[k + 1 :] - bins[k]
        far = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))
        for at in np.flatnonzero(far <= (1 - least) * np.maximum(n[k + 1 :], n[k]) + 1e-9):
            if plain_similarity(words[i], words[ids[k + 1 + at]]) >= least - 1e-12:
                yield i, ids[k + 1 + int(at)]


def classes(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


words = st.lists(st.sampled_from("a b c d e".split()), max_size=30)


@settings(max_examples=60, deadline=None)
@given(words, st.integers(1, 5), st.integers(1, 3))
def test_labels_count_the_first_repeats(x, k, repeats):
    w = next(blocks(pa.array([" ".join(x), "a a a a a a a"])))[2]
    s, begin = orderminhash.labelled(*orderminhash.kmers(w, k), repeats)
    grams = [tuple(x[i : i + k]) for i in range(len(x) - k + 1)] if len(x) >= k else [tuple(x)] * bool(x)
    seen, want = {}, []
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= repeats:
            want.append((g, seen[g]))
    got = s[: begin[1]].tolist()
    assert len(got) == len(want) == len(set(got)) and begin[2] - begin[1] == min(repeats, 8 - k)
    assert dict(zip(want, got, strict=True)) == {g: h for g, h in zip(want, got, strict=True)}


@settings(max_examples=200, deadline=None)
@given(words, words, st.sampled_from([0.3, 0.6, 0.8, 1.0]))
def test_banded_alignment_equals_the_table(x, y, least):
    a, b = (next(blocks(pa.array([" ".join(t)])))[2] for t in (x, y))
    a, b = (w.hashes() if len(w) else np.zeros(0, np.uint64) for w in (a, b))
    edits = plain_edits(x, y)
    assert whole_edits(x, y) == edits
    want = 1 - edits / max(len(x), len(y)) if x or y else 0.0
    got = orderminhash.edit_similarity(a, b, least)
    assert got == pytest.approx(want) if want >= least - 1e-12 and want > 0 else got == 0
    long, short = (x, y) if len(x) >= len(y) else (y, x)
    for most in (0, 2, 5, 40):
        assert orderminhash.banded_edits([ord(c) for c in long], [ord(c) for c in short], most) == min(edits, min(most, len(long)) + 1) or edits > most


def test_alignment_of_long_texts():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 400, 6000)
    b = np.array([x for x in a if rng.random() > 0.05])
    b[rng.integers(0, len(b), 300)] = 999
    want = 1 - whole_edits(a.tolist(), b.tolist()) / 6000
    assert orderminhash.edit_similarity(a, b, 0.8) == pytest.approx(want) and want > 0.85
    assert orderminhash.edit_similarity(a, rng.permutation(a), 0.8) == 0


def test_copy_without_the_first_footer(spark):
    rng = np.random.default_rng(7)
    vocab = ["".join(x) for x in itertools.product("abcdef", repeat=3)]
    footer = list(rng.choice(vocab, 10))
    sections = [list(rng.choice(vocab, 20)) for _ in range(12)]
    whole = " ".join(w for s in sections for w in s + footer)
    cut = " ".join(w for i, s in enumerate(sections) for w in (s + footer if i else s))
    d = spark.createDataFrame([(1, whole), (2, cut)], "doc_id long, text string")
    assert {r.class_id for r in orderminhash.near_duplicates(d, "doc_id", "text").collect()} == {1}


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        at = int(rng.integers(0, len(w)))
        w[at : at + 1] = [["zz"], [], [w[at], "yy"]][int(rng.integers(0, 3))]
    return w


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(x) for x in itertools.product("abcdef", repeat=3)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(vocab, 120))
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, int(rng.integers(0, 4)))) for _ in range(6)]
    texts += [texts[0].upper() + "!", " ".join(rng.choice(vocab, 120))]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)]
    rows += [(900, None, "c", 1), (901, None, "c", 1), (902, "", "c", 1), (903, "", "c", 1), (904, "two words", "c", 1), (905, "Two, words", "c", 1), (906, "...", "c", 1), (0, texts[0], "c", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest string, class_id int")
    got = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(d, "doc_id", "text").collect()}
    links = [*similar_pairs({i: plain_words(t) for i, t, _, _ in rows if t}), (902, 903)]
    assert got == classes([r[0] for r in rows], links)
    assert orderminhash.near_duplicates(d.limit(0), "doc_id", "text").count() == 0


def test_hot_groups(spark):
    """One base with many edited copies, and one with many exact copies."""
    rng = np.random.default_rng(5)
    vocab = ["".join(x) for x in itertools.product("abcdef", repeat=3)]
    base = list(rng.choice(vocab, 200))
    rows = [(i, " ".join(edited(rng, base, 2)) if i else " ".join(base)) for i in range(150)] + [(1000 + i, "one text that is copied again and again") for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(d, "doc_id", "text").collect()}
    assert {out[i] for i in range(150)} == {0} and {out[1000 + i] for i in range(150)} == {1000}


def test_pairs_inside_a_hot_passage(spark):
    """Texts of different classes share most of their words; in each planted pair a few more are equal."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for g in range(60):
        own = [f"o{g}x{i}" for i in range(50)]
        rows += [(2 * g, " ".join(passage + own)), (2 * g + 1, " ".join(passage + own[:15] + [f"n{g}x{i}" for i in range(35)]))]
    of = lambda i: rows[i][1].split()
    assert plain_similarity(of(0), of(2)) < 0.8 < plain_similarity(of(0), of(1))
    d = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(d, "doc_id", "text").collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == 120


def test_texts_that_mostly_repeat_a_pair_of_words(spark):
    """Similar ones that share their own words are found; those that share the repeats alone share no class by chance of it."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(30):
        own = [f"o{g}x{i}" for i in range(60)]
        rows += [(2 * g, " ".join(own + ["is", "onhe"] * 60)), (2 * g + 1, " ".join(edited(rng, own, 5) + ["is", "onhe"] * 58))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in orderminhash.near_duplicates(d, "doc_id", "text").collect()}
    assert got == classes([i for i, _ in rows], list(similar_pairs({i: t.split() for i, t in rows})))
    assert got == {i: i - i % 2 for i in got}


def test_repeated_rows_and_several_texts_of_a_key(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base.replace("w30", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(1, base)] * 300 + [(2, near)] * 300 + [(3, other), (1, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = orderminhash.near_duplicates(d, "doc_id", "text").collect()
    assert len(got) == len(rows) and {r.class_id for r in got} == {1}


def test_recall_on_the_documents(spark):
    """Classes by all pairs of edit similarity 0.8 or more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.class_id, r.rep_id) for r in orderminhash.near_duplicates(docs, "doc_id", "text").collect()}
    words = {r.doc_id: plain_words(r.text) for r in docs.collect() if got[r.doc_id][1] == r.doc_id}
    pairs = list(similar_pairs(words))
    found = [got[a][0] == got[b][0] for a, b in pairs]
    assert len(pairs) >= 50 and np.mean(found) >= 0.95
    label = classes(words, pairs)
    assert all(label[got[i][0]] == label[i] for i in words)  # no class holds texts that no links join


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(1)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    rand = [tuple(int(x) for x in rng.integers(200, 260, 2)) for _ in range(40)]
    edges = path + star + rand
    got = {r.node: r.label for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == classes({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    for cut in (0, 50, len(edges)):  # in two steps
        frame = lambda e: spark.createDataFrame(e, "a long, b long")
        both = {r.node: r.label for r in joined(components(frame(edges[:cut])), frame(edges[cut:])).collect()}
        assert both == classes({x for e in edges for x in e}, edges)


def test_only_the_rows_of_some_keys(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("t"), "id").alias("t")).unionByName(spark.createDataFrame([(7, "again"), (None, "none")], "id long, t string"))
    keys = spark.createDataFrame([(7,), (19_999,), (7,), (55_555,), (None,)], "id long")
    assert sorted(tuple(r) for r in only(rows, keys, "id").collect()) == [(7, "again"), (7, "t7"), (19_999, "t19999")]
    assert only(rows, keys.limit(0), "id").count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([centres[i % 12] + rng.normal(size=(1, 16)) for i in range(600)])
    x[7] = x[8] = x[9] = x[0]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    bad = [(1000, None, "c"), (1001, [0.0] * 16, "c"), (1002, [float("nan")] + [1.0] * 15, "c"), (1003, [1.0, None] + [1.0] * 14, "c"), (1004, [], "c"), (1005, [float("inf")] * 16, "c"), (None, [1.0] * 16, "c"), (1020, [1.0, 2.0], "c"), (0, rows[0][1], "c")]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in curveknn.nearest(d, "vec_id", "embedding", "id % 20 = 0", k=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert all(v == pytest.approx(s[i]) for i, v in found.values())
        assert [v for _, v in (found[k] for k in sorted(found))] == sorted((v for _, v in found.values()), reverse=True)
        hit += len({i for i, _ in found.values()} & set(order))
    assert hit / (10 * len(got)) >= 0.9
    first = [got[0][k][0] for k in sorted(got[0])]
    equal = [i for i in first if i in (7, 8, 9)]
    assert equal == [7, 8, 9][: len(equal)]  # equal vectors in the order of their ids
    few = curveknn.nearest(d.where("vec_id in (0, 1, 2)"), "vec_id", "embedding", "id % 20 = 0", k=10).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == sorted([1, 2], key=lambda i: -x[0] @ x[i])
    assert curveknn.nearest(d.limit(0), "vec_id", "embedding", "id % 20 = 0").count() == 0


@pytest.mark.parametrize("k", [5, 20])
def test_ties_go_to_the_smaller_id(spark, k):
    """All vectors of -1 and 1: many scores are equal, and every candidate is in reach."""
    x = np.array(list(itertools.product([-1.0, 1.0], repeat=8)))
    ids = np.random.default_rng(4).permutation(len(x))
    d = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in curveknn.nearest(d, "vec_id", "embedding", "id % 20 = 0", k=k, ranges=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 256, 20))
    for q, found in got.items():
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        assert [(i, s_) for _, i, s_ in sorted(found)] == [(ids[i], s[i]) for i in order]


def test_parts_of_ranges_and_queries(spark):
    x = np.random.default_rng(6).normal(size=(300, 8))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole, cut = (sorted(tuple(r) for r in curveknn.nearest(d, "vec_id", "embedding", "id % 2 = 0", k=7, curves=2, max_rows=m).collect()) for m in (50_000, 9))
    assert whole == cut and len(whole) == 150 * 7


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in e.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = {}
    for r in curveknn.nearest(e, "vec_id", "embedding", "id % 20 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for q, got in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        share.append(len(got & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(share) >= 0.9


def test_recall_without_structure(spark):
    """Enough vectors for all 16 ranges of a curve."""
    x = np.random.default_rng(17).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in curveknn.nearest(d, "vec_id", "embedding", "id % 20 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -9
        share.append(len(got & set(np.argsort(-s)[:20].tolist())) / 20)
    print("recall", np.mean(share))
    assert len(found) == 150 and np.mean(share) >= 0.9


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "bpe"]
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
        assert kept[-1].columns == docs.columns
        assert {r.doc_id for r in kept[-1].collect()} <= {r.doc_id for r in kept[-2].collect()}
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    left = {r.doc_id for r in kept[3].collect()}
    links = list(similar_pairs({i: plain_words(t) for i, t in texts.items()}))
    label = classes(texts, links)
    assert left == {i for i in texts if label[i] == i}
    from tests.llm.test_text_operators import plain_hits

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept[4].collect()} == {i for i in left if not plain_hits(texts[i], items, 10)[1]}
    last = p.STAGES[-1][1](spark, kept[4], sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept[4].collect()} and zlib.crc32(b"") == 0
    strange = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (None, "a b c", "en", "s", 5)], docs.schema)
    assert {r.doc_id for r in p.drop_near_duplicates(spark, strange, sf).collect()} == {1, 2, None}
