"""License scan: exact phrases by words, and short notices with a bounded number of edits.

A notice that occurs with at most k edits holds one of its k + 1 pieces unchanged (the pigeonhole
principle).  One pass of an Aho-Corasick automaton over the normalised text (words, one space between)
finds these exact seeds; around each, the regex library matches the whole notice with at most k edits and
reports the best span.  A part that tells licenses apart, such as a version number, takes no edits.

Edge cases: null and empty texts have no words, labels or matches, and score 0.  Texts are scanned whole;
a match never spans two texts.  Equal labels are listed once.  Repeated rows are scanned one by one; an
empty table gives no rows.  Columns other than key and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import small_batches
from wellframe.llm.words import Words, blocks, word_hash

#: phrase -> label
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, part that may be edited, exact words after it).  Names and phrases of public licenses.
NOTICES = [
    ("mit", "released under the mit license", ""),
    ("mit", "licensed under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("apache-2", "licensed under the apache license version", " 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ""),
    ("gpl", "licensed under the gnu general public license", ""),
    ("gpl", "under the terms of the gnu general public license", ""),
    ("lgpl", "gnu lesser general public license", ""),
    ("agpl", "gnu affero general public license", ""),
    ("mpl-2", "mozilla public license version", " 2"),
    ("cc-by", "creative commons attribution", " international"),
    ("cc-by-nc", "creative commons attribution noncommercial", ""),
    ("cc0", "creative commons zero universal public domain dedication", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
]
#: One edit for so many characters.
CHARS_PER_EDIT = 10


class Scanner:
    """The automaton and patterns of some notices."""

    def __init__(self, notices: list[tuple[str, str, str]], phrases: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = []
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (label, fuzzy, tail) in enumerate(notices):
            k = max(1, len(fuzzy) // chars_per_edit)
            self.notices.append((label, len(fuzzy), len(tail), k, regex.compile(f"(?b)(?<![^ \n])(?:{regex.escape(fuzzy)}){{e<={k}}}{regex.escape(tail)}(?![^ \n])")))
            cuts = [round(j * len(fuzzy) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(fuzzy[a:b], []).append((i, a))
        for s, where in seeds.items():
            self.automaton.add_word(s, (len(s), where))
        self.automaton.make_automaton()
        self.phrases = [(p.encode(), word_hash(p.encode().split()), label) for p, label in phrases.items()]

    def base(self, w: Words) -> dict[int, list[tuple[int, str]]]:
        """text -> (start word in it, label) of every place of a phrase, in order."""
        out: dict[int, list[tuple[int, str]]] = {}
        if not len(w):
            return out
        h = w.hashes()
        for text, ph, label in self.phrases:
            m = len(ph)
            if len(h) < m:
                continue
            at = np.flatnonzero(h[m - 1 :] == ph[-1])
            for k in range(m - 1):
                at = at[h[at + k] == ph[k]]
            for a in at.tolist():
                i = int(np.searchsorted(w.first, a, "right")) - 1
                if a + m <= w.first[i + 1] and w.joined(a, a + m) == text:
                    out.setdefault(i, []).append((a - int(w.first[i]), label))
        return out

    def fuzzy(self, w: Words) -> dict[int, list[tuple[str, int, int, int, float]]]:
        """text -> (label, edits, first word, word after the last, similarity) of every match."""
        out: dict[int, list] = {}
        if not len(w):
            return out
        size = w.end - w.start
        to = np.cumsum(size + 1) - (size + 1)  # where each word begins in the normalised text
        norm = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
        inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        norm[inside] = w.low[np.arange(int(size.sum())) + np.repeat(w.start - (np.cumsum(size) - size), size)]
        lasts = w.first[1:][np.diff(w.first) > 0] - 1
        norm[to[lasts] + size[lasts]] = 10  # a text's end
        text = norm.tobytes().decode("latin-1")
        tried: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            for i, offset in where:
                label, n, tail, k, pattern = self.notices[i]
                start = end - length + 1 - offset
                if start < tried.get(i, -1):
                    continue
                lo, hi = max(0, start - k), min(len(text), start + n + tail + k + 1)
                cut = text.rfind("\n", lo, end - length + 1)
                lo = cut + 1 if cut >= 0 else lo
                cut = text.find("\n", end + 1, hi)
                hi = cut if cut >= 0 else hi
                m = pattern.search(text, lo, hi)
                if m is None:
                    continue
                tried[i] = m.end()
                a = int(np.searchsorted(to, m.start(), "right")) - 1
                b = int(np.searchsorted(to, m.end() - 1, "right"))
                edits = sum(m.fuzzy_counts)
                doc = int(np.searchsorted(w.first, a, "right")) - 1
                out.setdefault(doc, []).append((label, edits, a - int(w.first[doc]), b - int(w.first[doc]), 1 - edits / n))
        return out


_scanners: dict[str, Scanner] = {}


def scan(docs: DataFrame, key: str, text: str, notices: list = NOTICES, phrases: dict[str, str] = BASE_PHRASES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches: array of (label, edits, first_word, end_word, start, end), the last two the span in the
    text's UTF-8 bytes.  score: 1 for an exact phrase, or the best match's share of unedited characters.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    match = "array<struct<label:string,edits:int,first_word:bigint,end_word:bigint,start:bigint,end:bigint>>"
    match_type = pa.list_(pa.struct([("label", pa.string()), ("edits", pa.int32()), *((n, pa.int64()) for n in ("first_word", "end_word", "start", "end"))]))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches {match}"
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), match_type]
    names = ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    ident = repr((notices, phrases, chars_per_edit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanners.get(ident) or _scanners.setdefault(ident, Scanner(notices, phrases, chars_per_edit))
        for b in batches:
            rows = []
            for lo, hi, w in blocks(b.column(1)):
                base, fuzzy = s.base(w), s.fuzzy(w)
                for i in range(hi - lo):
                    first, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
                    places, found = base.get(i, ()), fuzzy.get(i, ())
                    mine = sorted({x for _, x in places})
                    starts = [a for a, _ in places]
                    zero = int(w.offsets[i])
                    spans = [{"label": x, "edits": e, "first_word": a, "end_word": z, "start": int(w.start[first + a]) - zero, "end": int(w.end[first + z - 1]) - zero} for x, e, a, z, _ in found]
                    score = max([1.0 if places else 0.0, *(f[4] for f in found)])
                    rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(mine), ",".join(sorted({*mine, *(f[0] for f in found)})), score, spans))
            yield pa.record_batch([b.column(0).cast(key_type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
