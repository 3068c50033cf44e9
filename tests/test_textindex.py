"""Stems by published examples; ranked search against a scan of all stretches of every text."""

import itertools
import random

import pytest

from wellframe.functions.stem import stem
from wellframe.operators import textindex as ti
from wellframe.plans import search

# Pairs of the stemmer's published sample vocabulary and description.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistent": "consist", "consistently": "consist", "consolation": "consol", "console": "consol", "consolidate": "consolid",
    "knack": "knack", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knees": "knee",
    "knightly": "knight", "knots": "knot", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi",
    "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "cry": "cri", "by": "by", "say": "say", "dying": "die", "news": "news",
    "generate": "generat", "generation": "generat", "communism": "communism", "inning": "inning", "proceed": "proceed", "rolling": "roll",
    "losses": "loss", "drilled": "drill", "drilling": "drill", "relational": "relat", "vileness": "vile", "feudalism": "feudal", "happy": "happi",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def holds(words, phrase):
    """Places at which a phrase starts in a list of (place, stem)."""
    return [p for p, _ in words if all(any(q == p + d and s == t for q, s in words) for t, d in phrase.terms)]


def scanned(text, query):
    """The rank by trying every stretch: minimal ones satisfy an alternative while no part of them does."""
    words = [(i, stem(m[0])) for i, m in enumerate(ti.WORD.finditer(text.lower()), 1) if m[0] not in ti.STOP_WORDS]
    asked = {t for a in query for p in a for t, _ in p.terms}
    words = [w for w in words if w[1] in asked]
    able = [a for a in query if all(bool(holds(words, p)) == p.wanted for p in a)]
    good = set()
    for i, j in itertools.combinations_with_replacement(range(len(words)), 2):
        part = words[i : j + 1]
        if any(all(holds(part, p) for p in a if p.wanted) for a in able):
            good.add((i, j))
    least = [(i, j) for i, j in good if (i + 1, j) not in good and (i, j - 1) not in good]
    return sum(0.1 / (1 + (words[j][0] - words[i][0]) - (j - i)) for i, j in least)


QUERIES = ["loss", "mud loss", '"mud losses"', "mud -casing", '"loss of mud" or casing', '"mud loss" casing or "the casing"', "-mud", "or", '"of the"', '-"mud loss" mud', "mud mud", "mud-loss casing"]


@pytest.mark.parametrize("query", QUERIES)
def test_density_equals_scan(query):
    r = random.Random(query)
    parsed = ti.parse(query)
    for _ in range(150):
        text = " ".join(r.choice(["mud", "Mud", "losses", "loss", "of", "the", "casing", "drilled", "x"]) for _ in range(r.randrange(16)))
        assert ti.density(ti.places(text), parsed) == pytest.approx(scanned(text, parsed))


def test_search_equals_scan(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r["query"], r.doc_id): r.s for r in search.websearch(search.Tables(spark, sf)).collect()}
    for name, q in search.WEB_QUERIES.items():
        want = {k: scanned(t, ti.parse(q)) for k, t in docs.items()}
        assert {k: s for (n, k), s in got.items() if n == name} == pytest.approx({k: round(v, 6) for k, v in want.items() if v}, abs=2e-6)
    assert {n for n, _ in got} == set(search.WEB_QUERIES)


def test_written_index_and_filters(spark, tmp_path):
    rows = [(1, "Significant mud losses observed while drilling Tipam sandstone at 1920 m."), (2, "BOP pressure testing completed."), (3, None), (4, "")]
    index = ti.build(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    ti.write(index, f"{tmp_path}/index")
    found = ti.search(spark.read.parquet(f"{tmp_path}/index"), {"a": "tipam losses", "b": "tested -mud", "c": "absent"})
    assert sorted((r["query"], r.key) for r in found.collect()) == [("a", 1), ("b", 2)]
    chunks = spark.createDataFrame([(1, 7, 1, "Tipam", "F", 1900.0, 1950.0), (2, 7, None, "Girujan", "F", None, None)], "key long, doc long, page long, formation string, field string, md_from double, md_to double")
    events = spark.createDataFrame([(7, 2, "kick"), (8, 1, "loss")], "doc long, page long, event_type string")
    both = spark.createDataFrame([(1, 0.02), (2, 0.01)], "key long, score double")
    keys = lambda **f: [r.key for r in ti.answers(both, chunks, events, **f).collect()]
    assert keys() == [1, 2] and keys(limit=1) == [1] and keys(formation="Tipam") == [1] and keys(formation="Barail") == [] and keys(field="F") == [1, 2]
    assert keys(md_from=1951.0) == [2] and keys(md_to=1899.0) == [2] and keys(md_from=1950.0, md_to=1900.0) == [1, 2]
    assert keys(event_type="kick") == [2] and keys(event_type="loss") == []
    assert ti.search(index.limit(0), {"a": "x"}).collect() == []


def test_stems_begin_their_words():
    """What ``matching`` relies on, over words with all endings; words that are stemmed as a whole are not looked for so."""
    from wellframe.functions import stem as st

    roots = ["rat", "hop", "happ", "commun", "relat", "stab", "flu", "sens", "log", "apolog", "vietnam", "rad", "operat", "cal", "ski", "fl", "gener", "roll", "y", "ply", "hum", "tr"]
    ends = ["", "e", "y", "ies", "ied", "ed", "ing", "ingly", "eed", "eedly", "s", "sses", "er", *st.STEP_2, *st.STEP_3, *st.STEP_4, "ly", "ogy", "ability", "ization", "fulness", "ously", "iveness", "ency", "ancy", "ement", "ying", "ye", "ll", "lle"]
    for w in {a + b + c for a in roots for b in ends for c in ("", "s", "ly", "ed", "ing", "al")}:
        t = stem(w)
        if t not in st.WHOLE.values() and w not in st.STOP_WORDS:
            assert w.startswith(t[:-1] if len(t) > 2 else t), (w, t)


def test_texts_without_an_index(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted((r["query"], r.key, r["rank"]) for r in df.collect())
    assert rows(ti.search_texts(docs, "doc_id", "text", search.WEB_QUERIES)) == rows(ti.search(ti.build(docs, "doc_id", "text"), search.WEB_QUERIES)) != []
