"""Chunk tags against plain code; refreshing against building anew."""

import re

from wellframe.functions import fuzzy
from wellframe.functions import text as tx
from wellframe.operators import indexing
from wellframe.plans import search

squash = lambda x: " ".join(x.split()).lower()


def plain_names(text, meaning):
    out, at = [], 0
    names = sorted(meaning, key=len, reverse=True)
    while at < len(text):
        for a in names:
            m = re.compile(r"(?<!\w)" + r"\s+".join(map(re.escape, a.split())) + r"(?!\w)", re.I).match(text, at)
            if m:
                if meaning[a] not in out:
                    out.append(meaning[a])
                at = m.end() - 1
                break
        at += 1
    return out


def test_aliases(spark):
    aliases = indexing.Aliases.of({"Tipam": "T", "Tipam Sandstone": "TS", "girujan  CLAY": "G", "C++ (x)": "C", " ": "none"})
    texts = ["tipam sandstone over Girujan\nclay, tipam", "Tipams xtipam", "the c++ (x) TIPAM", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.f for r in df.withColumn("f", aliases.found(df.t)).orderBy("i").collect()]
    assert got[:4] == [plain_names(t, aliases.meaning) for t in texts[:4]] == [["TS", "G", "T"], [], ["C", "T"], []] and not got[4]
    assert [r.f for r in df.withColumn("f", indexing.Aliases.of({}).found(df.t)).collect()] == [[]] * 5


def test_index_equals_plain_code(spark, sf):
    meaning = indexing.Aliases.of(search._ALIASES).meaning
    pages, entities = search._pages(search.Tables(spark, sf))
    text = {(r.doc_id, r.page): r.text for r in pages.collect()}
    known = {}
    for r in sorted(entities.collect(), key=lambda r: r.ord):
        known.setdefault((r.doc_id, r.page), []).append(r)
    got = {(r.doc_id, r.page, r.chunk_no): r for r in search.chunk_index(search.Tables(spark, sf)).collect()}
    want = {(d, p, i): c for (d, p), t in text.items() for i, c in enumerate(tx.pack(t))}
    assert {k: r.chunk for k, r in got.items()} == want
    for (d, p, i), c in want.items():
        named, mine = plain_names(c, meaning), []
        for e in known.get((d, p), []):
            s = squash(e.snippet or "")
            if s and (s in squash(c) or len(s) >= 20 and fuzzy.partial_ratio(s, squash(c), 90.0) >= 90) or not s and e.formation in named:
                mine.append(e)
        r = got[d, p, i]
        assert r.formation == next((e.formation for e in mine if e.formation), named[0] if named else None)
        depths = [x for e in mine for x in (e.md_from_m, e.md_to_m) if x is not None]
        if depths:
            assert (r.md_from_m, r.md_to_m) == (min(depths), max(depths))
    assert len({r.formation for r in got.values()}) > 3


def test_only_changed_documents_are_read(spark, tmp_path):
    aliases = indexing.Aliases.of({"Tipam": "T"})
    pages = [(1, 0, "Tipam at 1,900 m"), (1, 1, "loss at 50 ft"), (2, 0, "nothing"), (3, 0, "going")]
    entities = [(1, 1, 0, "loss at 50", "B", 7.0, None), (2, 0, 0, None, "T", 1.0, 2.0)]
    p, e = "doc_id long, page int, text string", "doc_id long, page int, ord int, snippet string, formation string, md_from_m double, md_to_m double"
    old = indexing.build(spark.createDataFrame(pages, p), spark.createDataFrame(entities, e), aliases)
    old.withColumn("chunk", old.chunk).write.parquet(f"{tmp_path}/old")
    index = spark.read.parquet(f"{tmp_path}/old")
    assert {(r.doc_id, r.page): (r.formation, r.md_from_m, r.md_to_m) for r in index.collect()} == {(1, 0): ("T", 1900.0, 1900.0), (1, 1): ("B", 7.0, 7.0), (2, 0): (None, None, None), (3, 0): (None, None, None)}
    marked = index.replace("nothing", "kept as it was", "chunk").replace("going", "kept as it was", "chunk")  # would be overwritten if read again
    new_pages = [(1, 0, "Tipam at 1,950 m"), (1, 1, "loss at 50 ft"), (2, 0, "nothing"), (4, 0, "new Tipam")]
    out = indexing.refreshed(marked, spark.createDataFrame(new_pages, p), spark.createDataFrame(entities, e), aliases)
    assert {(r.doc_id, r.page): (r.chunk, r.md_to_m) for r in out.collect()} == {(1, 0): ("Tipam at 1,950 m", 1950.0), (1, 1): ("loss at 50 ft", 7.0), (2, 0): ("kept as it was", None), (4, 0): ("new Tipam", None)}
    moved = [(1, 1, 0, "loss at 50", "B", 8.0, None), entities[1]]
    again = indexing.refreshed(index, spark.createDataFrame(pages, p), spark.createDataFrame(moved, e), aliases)
    fresh = indexing.build(spark.createDataFrame(pages, p), spark.createDataFrame(moved, e), aliases).select(again.columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, fresh.collect()))
