"""Partial ratios and names by similarity against plain tables of common subsequences."""

import random

import pytest

from wellframe.functions import fuzzy
from wellframe.plans import search


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    m, n = len(a), len(b)
    spans = {(max(0, i), min(n, i + m)) for i in range(-m + 1, n)}
    out = max(200 * common(a, b[i:j]) / (m + j - i) for i, j in spans)
    return max(out, max((200 * common(b, a[i:j]) / (m + j - i) for i in (0,) for j in range(1, m)), default=0), max((200 * common(b, a[i:]) / (m + m - i) for i in range(1, m)), default=0)) if m == n else out


@pytest.mark.parametrize("least", [0.0, 60.0, 80.0, 90.0])
def test_partial_ratio(least):
    r = random.Random(least)
    for _ in range(400):
        letters = r.choice(["ab", "abcdefgh "])
        text = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        at = r.randrange(len(text) + 1)
        snippet = list(text[at : at + r.randrange(14)]) if r.random() < 0.7 else [r.choice(letters) for _ in range(r.randrange(12))]
        for _ in range(r.randrange(3)):
            if snippet:
                k = r.randrange(len(snippet))
                snippet[k : k + r.randrange(2)] = r.choice(["", "x", "a"])
        a, want = "".join(snippet), plain("".join(snippet), text)
        assert fuzzy.partial_ratio(a, text, least) == pytest.approx(want if want >= least else 0.0), (a, text)


def test_snippets_on_pages(spark):
    page = "Lost circulation at 2,410 m while drilling the Tipam sandstone; pumped 40 bbl of LCM pill."
    rows = [(1, "lost  CIRCULATION at 2,410 m", page), (2, "lost circu1ation at 2,4l0 m", page), (3, "casing was run to 1,900 m", page), (4, " ", page), (5, None, page), (6, "x", None), (7, "Tipam sandst0ne", page)]
    df = spark.createDataFrame(rows, "i int, s string, p string")
    got = {r.i: r.q for r in df.withColumn("q", fuzzy.snippet_ratio(df.s, df.p, 80.0)).collect()}
    squash = lambda x: " ".join(x.lower().split())
    assert got[1] == 100.0 and got[3] == got[4] == 0.0 and got[5] is None and got[6] is None
    assert {i: got[i] for i in (2, 7)} == pytest.approx({i: plain(squash(rows[i - 1][1]), squash(page)) for i in (2, 7)})


def test_registered_snippets(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None}
    got = {(r.doc_id, r.page): r.ratio for r in search.fuzzy_snippets(search.Tables(spark, sf)).collect()}
    squash = lambda x: " ".join(x.split()).lower()
    some = [k for k in sorted(docs) if len(docs[k]) < 700][:25]
    for k in some:
        for page in (k, k + 1):
            if page in docs and len(docs[page]) < 700:
                s = squash(docs[k][k % 200 : k % 200 + 80].translate(str.maketrans("el", "c1")))
                want = plain(s, squash(docs[page])) if s else 0.0
                assert got.get((k, page), 0.0) == pytest.approx(want if want >= 80 else 0.0, abs=1e-4)
    assert any(k == p for k, p in got) and any(v < 100 for v in got.values())


def test_names_with_slips(spark):
    r = random.Random(6)
    known = ["Tipam Sandstone", "Girujan Clay", "Barail Main", "Barail Coal", "Kopili", "Sylhet Limestone", "Langpar", "Dikom-1", "Dikom-2", "Nambor", "ab", "b"]
    names = [n.upper() + " " for n in known] + ["Tipam Sandstnoe", "Tipam Sandston", "Girujn Clay", "Sylhet Limestome", "Dikom-3", "Dikom", "Barail", "kopil1", "Kopilli", "", None, "zzz", "ab", "a b"]
    for n in list(known):
        for _ in range(6):
            x = list(n)
            k = r.randrange(len(x))
            x[k : k + r.randrange(2)] = r.choice("xyzao")
            names.append("".join(x))
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    dim = spark.createDataFrame([(k, f"F{i}") for i, k in enumerate(known)], "a string, f string")
    got = {x.i: x.f for x in fuzzy.resolve(df, "n", dim, "a", "f").collect()}
    assert len(got) == len(names)
    for i, n in enumerate(names):
        squashed = " ".join((n or "").lower().split())
        score = {f"F{k}": 101.0 if a.lower() == squashed else 200 * common(a.lower(), squashed) / (len(a) + len(squashed)) for k, a in enumerate(known)} if n is not None else {}
        top = max(score.values(), default=0)
        best = [f for f, v in score.items() if v == top and v >= 90]
        assert got[i] == (best[0] if len(best) == 1 else None), n
