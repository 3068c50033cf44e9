"""Repeated passages by recompression (Jez, 2013): equal word sequences get equal symbols, whatever stands around them.

A round of recompression names maximal runs of one symbol, then pairs: every symbol is a left or a right one by a bit of its
name and the round, and a left one followed by a right one makes a new symbol.  A name is a mix of what it replaces, so
all tasks give equal names to equal runs and pairs, over the whole corpus, without a dictionary that would have to be moved in
each round.  Of every symbol we know the words that decided it: its own and those of neighbours that were looked at.

A window is ``window`` consecutive words of one text.  What is wanted are the windows whose word sequence starts earlier too, by
key, then place.  Three Spark rounds find them without moving windows that cannot repeat:

1. *Reveal.*  Each window has a sign: of the symbols of a low level that its own words decide, that of the least hash (a window
   without one is its own sign).  Equal windows have equal signs.  Signs, symbols of two high levels and each whole
   text's name are counted; signs that occur twice and symbols that occur earlier come back to their texts.
2. *Verify.*  A high symbol that occurs earlier settles all windows inside it.  Of the others those with a shared sign send 96
   bits of their words, and all but the first of equal ones come back.
3. The words of these windows are cut out of the texts.

What is sent is packed by the task, once for each distinct key of some million, before it is shuffled: a passage
that a third of all texts holds costs one entry a task.  Texts without a shared sign are not moved.

Edge cases: null texts have no words; texts of fewer words than a window are left whole.  Texts of one key, and those
of a null key (after all others), are told apart and ordered by their digests; of equal rows one is first.  An empty table
gives no rows.  Columns other than key and text are neither read nor returned.  Long texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import free_memory, likely, small_batches, staged
from wellframe.llm.words import columns, mix, powers

#: Rounds before signs are taken, and before high symbols are.  A round shortens a text by a quarter or so.
LOW, HIGH = 2, (12, 16)
#: What a reply is about: a sign, a symbol of one of the HIGH levels, the whole text.
SIGN, WHOLE = 0, 3
#: Entries that a task packs together, and characters of text for each bucket of entries.
PACKED = 1 << 20
BUCKET_CHARS = 64 << 20
#: Bytes of text that arrays are made of at a time; a longer text is alone.
BLOCK_BYTES = 1 << 21

_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PAIR_L, _PAIR_R, _RUN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Sequence:
    """Hashes of any stretch of a sequence of numbers."""

    def __init__(self, x: np.ndarray, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * powers(base, len(x)), out=self.sums[1:])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * powers(self.inverse, len(self.sums))[lo]


class Texts:
    """The words of several texts: byte spans and each text's first word (with the end)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(self.raw)
        inside = ~_IS_SPACE[self.raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])[:n]))
        self.end = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])[:n])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def words(self, base: int) -> np.ndarray:
        """A hash of every word."""
        return mix(Sequence(self.raw.astype(np.uint64) + np.uint64(1), base).hash(self.start, self.end))


def texts(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, their words), some BLOCK_BYTES at a time."""
    raw, offsets = columns(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1))
        yield lo, hi, Texts(raw, offsets[lo : hi + 1])
        lo = hi


@dataclass
class Symbols:
    """A level: names, the words [lo, hi) that each stands for, and those [left, right) that decided it.

    ``left`` is a place before the text, or ``right`` one after it, where the text's border was looked at.
    """

    name: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray


def words_as_symbols(h: np.ndarray, first: np.ndarray) -> Symbols:
    at = np.arange(len(h), dtype=np.int64)
    return Symbols(h, np.repeat(np.arange(len(first) - 1), np.diff(first)), at, at + 1, at, at + 1)


def _neighbours(s: Symbols, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What decided the symbols before ``begin`` and after ``end``: (their left, their right)."""
    n, doc = len(s.name), s.doc[begin]
    before, after = np.maximum(begin - 1, 0), np.minimum(end + 1, n - 1)
    left = np.where((begin > 0) & (s.doc[before] == doc), s.left[before], first[doc] - 1)
    right = np.where((end < n - 1) & (s.doc[after] == doc), s.right[after], first[doc + 1] + 1)
    return left, right


def named_runs(s: Symbols, first: np.ndarray) -> Symbols:
    """Runs of one symbol, maximal in a text, under one name each; that a run ends is seen at its neighbours."""
    if not len(s.name):
        return s
    new = np.ones(len(s.name), dtype=bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(s.name)) - 1
    count = (end - begin + 1).astype(np.uint64)
    name = np.where(count > 1, mix(s.name[begin] + count * _RUN), s.name[begin])
    left, right = _neighbours(s, first, begin, end)
    return Symbols(name, s.doc[begin], s.lo[begin], s.hi[end], left, right)


def named_pairs(s: Symbols, first: np.ndarray, level: int) -> Symbols:
    """A left symbol and a right one after it under one name.

    Two symbols know by themselves that they are a pair; one alone looked at the neighbour on its open side.
    """
    if not len(s.name):
        return s
    is_left = mix(s.name, 1000 + level) >> np.uint64(63) == 1
    pair = np.zeros(len(s.name), dtype=bool)
    pair[:-1] = is_left[:-1] & ~is_left[1:] & (s.doc[1:] == s.doc[:-1])
    begin = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
    two = pair[begin]
    end = begin + two
    name = np.where(two, mix(s.name[begin] * _PAIR_L + s.name[end] * _PAIR_R), s.name[begin])
    left, right = _neighbours(s, first, begin, end)
    left = np.where(two | is_left[begin], s.left[begin], left)
    right = np.where(two | ~is_left[begin], s.right[end], right)
    return Symbols(name, s.doc[begin], s.lo[begin], s.hi[end], left, right)


def levels(h: np.ndarray, first: np.ndarray) -> dict[int, Symbols]:
    """The levels that are asked for: LOW and HIGH."""
    s, out = words_as_symbols(h, first), {}
    for level in range(1, HIGH[-1] + 1):
        s = named_pairs(named_runs(s, first), first, level)
        if level == LOW or level in HIGH:
            out[level] = s
    return out


def least(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place of the least of p[lo:hi] for each of many stretches, none empty."""
    best, width, out = np.arange(len(p)), 1, np.zeros(len(lo), dtype=np.int64)
    size = hi - lo
    better = lambda a, b: np.where(p[b] < p[a], b, a)
    while len(p) and width <= (size.max() if len(size) else 0):
        here = (size >= width) & (size < 2 * width)
        out[here] = better(best[lo[here]], best[hi[here] - width])
        nxt = np.minimum(np.arange(len(p)) + width, len(p) - 1)
        best = better(best, best[nxt])
        width *= 2
    return out


@dataclass
class Parsed:
    """One block of texts: its windows and their signs, and its high symbols."""

    window: int
    first: np.ndarray
    doc: np.ndarray
    #: first word of every window, and the place of its sign
    start: np.ndarray
    sign_at: np.ndarray
    #: the sign's number among the distinct ones, and of these the key and the place
    sign: np.ndarray
    sign_key: np.ndarray
    place: np.ndarray
    #: high symbols and whole texts: kind, key, check, words
    kind: np.ndarray
    key: np.ndarray
    check: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    a: Sequence
    b: Sequence

    def fingerprints(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows that begin there."""
        end = start + self.window
        return mix(self.a.hash(start, end), 5), (mix(self.b.hash(start, end), 6) >> np.uint64(32)).astype(np.uint32)


def parse(t: Texts, window: int) -> Parsed:
    h, first = t.words(_A), t.first
    found = levels(h, first)
    a, b = Sequence(h, _A), Sequence(t.words(_B), _B)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(first[1:], np.diff(first)))
    low = found[LOW]
    lo, hi = np.searchsorted(low.left, start, "left"), np.searchsorted(low.right, start + window, "right")
    some = hi > lo
    pick = np.zeros(len(start), dtype=np.int64)
    pick[some] = least(mix(low.name, 7), lo[some], hi[some])
    chosen, sign = np.unique(np.where(some, pick, len(low.name) + start), return_inverse=True)
    own = chosen >= len(low.name)
    inner = np.where(own, 0, chosen) if len(low.name) else np.zeros(len(chosen), dtype=np.int64)
    begin = np.where(own, chosen - len(low.name), low.left[inner] if len(low.name) else 0)
    end = np.where(own, begin + window, low.right[inner] if len(low.name) else 0)
    key = mix(a.hash(begin, end) + (end - begin).astype(np.uint64) * _RUN, 8)
    kinds, keys, los, his = [], [], [], []
    for kind, level in enumerate(HIGH, 1):
        s = found[level]
        long = s.hi - s.lo >= window
        kinds.append(np.full(int(long.sum()), kind))
        keys.append(mix(s.name[long], 20 + kind))
        los.append(s.lo[long])
        his.append(s.hi[long])
    top = found[HIGH[-1]]
    full = np.flatnonzero(np.diff(first) >= window)
    cuts = np.searchsorted(top.doc, np.arange(len(first)))
    kinds.append(np.full(len(full), WHOLE))
    keys.append(mix(Sequence(top.name, _A).hash(cuts[full], cuts[full + 1]), 20 + WHOLE))
    los.append(first[full])
    his.append(first[full + 1])
    kind, symbol, lo, hi = (np.concatenate(x) for x in (kinds, keys, los, his))
    check = (mix(b.hash(lo, hi), 9) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # a sign's is 0
    return Parsed(window, first, doc, start, begin[sign] if len(start) else start, sign, key, begin, kind, symbol, check, lo, hi, a, b)


# ---------------------------------------------------------------- what tasks send and get back

#: key, check, row, code (place and kind), whether the key is known to be repeated
_FIELDS = (np.uint64, np.uint32, np.int64, np.uint32, np.uint8)
_SENT = "bucket int, settled boolean, n int, packed binary"


def pack(fields: tuple[np.ndarray, ...]) -> bytes:
    """Columns of entries in order of row and place, rows as differences."""
    key, check, rid, code, flag = fields
    raw = b"".join(x.tobytes() for x in (key, check, np.diff(rid, prepend=0), code, flag))
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpack(n: int, data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data, n * sum(np.dtype(f).itemsize for f in _FIELDS), codec="zstd", asbytes=True)
    out, at = [], 0
    for f in _FIELDS:
        out.append(np.frombuffer(raw, dtype=f, count=n, offset=at))
        at += n * np.dtype(f).itemsize
    out[2] = np.cumsum(out[2])
    return out


def judged(fields: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of key, row and place; which are the first of their key; which have an equal; which come back.

    Signs (check 0) come back if their key is repeated, others if they are not the first.
    """
    key, check, rid, code, flag = fields
    order = np.lexsort((code, rid)) if len(rid) and not np.all(np.diff(rid) > 0) else np.arange(len(rid))
    joint = key ^ mix(check.astype(np.uint64), 11)
    order = order[np.argsort(joint[order], kind="stable")]
    key, check, rid, code, flag = (x[order] for x in (key, check, rid, code, flag))
    first = np.ones(len(key), dtype=bool)
    first[1:] = (joint[order][1:] != joint[order][:-1]) | (check[1:] != check[:-1])
    group = np.cumsum(first) - 1
    many = np.bincount(group) > 1 if len(group) else np.zeros(0, dtype=bool)
    many |= np.bincount(group, weights=flag, minlength=len(many)) > 0
    repeated = many[group]
    return (key, check, rid, code, flag), first, repeated, np.where(check == 0, repeated & (flag == 0), ~first)


def pack_replies(rid: np.ndarray, code: np.ndarray) -> bytes:
    return pa.compress(np.diff(rid, prepend=0).tobytes() + code.tobytes(), codec="zstd", asbytes=True)


def unpack_replies(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data, 12 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.uint32, n, 8 * n)


def grouped(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(number, its places) of groups that are in order."""
    cuts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]), len(group)).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(group[lo]), slice(lo, hi)


def dealt(rid: np.ndarray, code: np.ndarray, groups: int) -> tuple[list[int], list[int], list[bytes]]:
    """Replies by groups of rows: (groups, numbers, packed)."""
    group = (mix(rid.view(np.uint64), 12) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((rid, group))
    group, rid, code = group[order], rid[order], code[order]
    out = [(g, i.stop - i.start, pack_replies(rid[i], code[i])) for g, i in grouped(group)]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


class Sender:
    """Collects a task's entries; every PACKED of them are deduplicated and dealt to buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.known, self.size = buckets, [], [], 0

    def add(self, key: np.ndarray, check: np.ndarray, rid: np.ndarray, code: np.ndarray) -> None:
        self.parts.append((key, check, rid, code.astype(np.uint32), np.zeros(len(key), np.uint8)))
        self.size += len(key)

    def settle(self, rid: np.ndarray, code: np.ndarray) -> None:
        """What needs no answer from other tasks goes straight to the replies."""
        self.known.append((rid, code.astype(np.uint32)))
        self.size += len(rid)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.size or self.size < PACKED and not last:
            return
        if self.parts:
            fields, first, repeated, back = judged(tuple(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            key, check, rid, code, _ = fields
            self.known.append((rid[back], code[back]))
            flag = (repeated & (check == 0)).astype(np.uint8)
            order = np.flatnonzero(first)
            bucket = (key[order] % np.uint64(self.buckets)).astype(np.int64)
            order = order[np.lexsort((code[order], rid[order], bucket))]
            bucket = (key[order] % np.uint64(self.buckets)).astype(np.int64)
            blobs, at, sizes = [], [], []
            for number, i in grouped(bucket):
                i = order[i]
                blobs.append(pack((key[i], check[i], rid[i], code[i], flag[i])))
                at.append(number)
                sizes.append(len(i))
            yield _sent(at, sizes, blobs, False)
        rid, code = (np.concatenate(x) for x in zip(*self.known, strict=True)) if self.known else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        if len(rid):
            yield _sent(*dealt(rid, code, self.buckets), True)
        self.parts, self.known, self.size = [], [], 0


def _sent(bucket: list[int], n: list[int], packed: list[bytes], settled: bool) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array([settled] * len(n), pa.bool_()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "settled", "n", "packed"])


def answered(sent: DataFrame, buckets: int) -> DataFrame:
    """rid, codes (32-bit codes as bytes) of what ``Sender`` sent, with what it settled.

    Replies go back in as few rows as may be: one for each bucket and group of rids, at most.
    """

    def judge(bucket: pa.Table) -> pa.Table:
        parts, rids, codes = [], [], []
        for settled, n, packed in zip(*(bucket.column(c).to_pylist() for c in ("settled", "n", "packed")), strict=True):
            if settled:
                rid, code = unpack_replies(n, packed)
                rids.append(rid)
                codes.append(code)
            else:
                parts.append(unpack(n, packed))
        if parts:
            (_, _, rid, code, _), _, _, back = judged(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
            rids.append(rid[back])
            codes.append(code[back])
        group, n, packed = dealt(np.concatenate(rids), np.concatenate(codes), buckets)
        return pa.table([pa.array(group, pa.int32()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], ["group", "n", "packed"])

    def give(group: pa.Table) -> pa.Table:
        rid, code = (np.concatenate(x) for x in zip(*map(unpack_replies, group.column("n").to_pylist(), group.column("packed").to_pylist()), strict=True))
        order = np.argsort(rid, kind="stable")
        rid, code = rid[order], code[order]
        rows = list(grouped(rid))
        return pa.table([pa.array([r for r, _ in rows], pa.int64()), pa.array([code[i].tobytes() for _, i in rows], pa.binary())], ["rid", "codes"])

    back = sent.groupBy("bucket").applyInArrow(judge, "group int, n int, packed binary")
    return back.groupBy("group").applyInArrow(give, "rid bigint, codes binary")


# ---------------------------------------------------------------- the Spark rounds


def _by_kind(codes: bytes) -> list[np.ndarray]:
    """The places that replies name, for each kind."""
    x = np.frombuffer(codes, np.uint32)
    return [x[x % 4 == k] // 4 for k in range(4)]


def revealed(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """rid, codes (bytes): shared signs, and high symbols that occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets)
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for lo, hi, t in texts(batch.column(1)):
                p, rid = parse(t, window), rids[lo:hi]
                doc = p.doc[p.place] if len(p.place) else p.place
                out.add(p.sign_key, np.zeros(len(doc), np.uint32), rid[doc], (p.place - p.first[doc]) * 4 + SIGN)
                doc = p.doc[p.lo] if len(p.lo) else p.lo
                out.add(p.key, p.check, rid[doc], (p.lo - p.first[doc]) * 4 + p.kind)
                yield from out.rows()
        yield from out.rows(last=True)
        free_memory()

    return answered(docs.select("rid", "text").mapInArrow(run, _SENT), buckets)


def verified(asked: DataFrame, window: int, buckets: int) -> DataFrame:
    """rid, codes: places of windows that start earlier too (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets)
        for batch in batches:
            rids, codes = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for lo, hi, t in texts(batch.column(1)):
                p = parse(t, window)
                n = int(p.first[-1])
                sign, earlier = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=np.int64)
                named = np.zeros((4, n + 1), dtype=bool)
                for i in range(lo, hi):
                    base = p.first[i - lo]
                    for kind, places in enumerate(_by_kind(codes[i])):
                        named[kind][base + places] = True
                sign = named[SIGN][p.sign_at]
                old = named[p.kind, p.lo]
                np.add.at(earlier, p.lo[old], 1)  # windows that begin in [lo, hi - window] lie in the symbol
                np.add.at(earlier, p.hi[old] - window + 1, -1)
                inside = np.cumsum(earlier)[p.start] > 0
                doc = p.doc[p.start] if len(p.start) else p.start
                rid, code = rids[lo:hi][doc], (p.start - p.first[doc]) * 4
                out.settle(rid[inside], code[inside])
                send = sign & ~inside
                key, check = p.fingerprints(p.start[send])
                out.add(key, check | np.uint32(1), rid[send], code[send])
                yield from out.rows()
        yield from out.rows(last=True)
        free_memory()

    return answered(asked.select("rid", "text", "codes").mapInArrow(run, _SENT), buckets)


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rid (bigint), key, text: rids are unique and in the order of keys."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") and rows.groupBy("key").count().where("`count` > 1 or key is null").isEmpty():
        return rows.select(F.col("key").cast("bigint").alias("rid"), "key", "text")
    order = [F.col("key").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ranged.select(F.monotonically_increasing_id().alias("rid"), "key", "text"), "numbered")


def kept(words: list[bytes], starts: np.ndarray, window: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal stretches of removed words, and the other words joined by one space."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    gone = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), b" ".join([words[i] for i in np.flatnonzero(~gone)])


def repeats(docs: DataFrame, key: str, text: str, window: int = 20) -> DataFrame:
    """key, n_words, n_removed (longs), kept_sha256, spans (array of first word, word after the last) of every row."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = numbered(docs, key, text)
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    shared = staged(revealed(rows, window, buckets), "shared")
    asked = staged(likely(rows.select("rid", "text"), shared, "rid").join(shared, "rid"), "asked")
    found = verified(asked, window, buckets).withColumnRenamed("codes", "places")
    span_type = pa.list_(pa.list_(pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, shas = [], []
            for t, codes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found_, rest = kept(t.split(), _by_kind(codes)[0].astype(np.int64), window)
                spans.append([list(x) for x in found_])
                shas.append(hashlib.sha256(rest).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(spans, span_type), pa.array(shas, pa.string())], ["r", "spans", "sha"])
        free_memory()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [(t or b"").split() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string())], ["rid", "key", "n_words", "whole"])

    removed = asked.select("rid", F.col("text").cast("binary").alias("text")).join(found, "rid").mapInArrow(cut, "r bigint, spans array<array<bigint>>, sha string")
    kind = docs.schema[key].dataType.simpleString()
    every = rows.select("rid", "key", F.col("text").cast("binary").alias("text")).mapInArrow(count, f"rid bigint, key {kind}, n_words bigint, whole string")
    out = every.join(removed, F.col("rid") == F.col("r"), "left")
    n_removed = F.aggregate(F.coalesce("spans", F.array().cast("array<array<bigint>>")), F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select(F.col("key").alias(key), "n_words", n_removed.alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"))


def without(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """``rows`` with the words of the spans cut out of the text, the others joined by one space; a null text stays."""
    small_batches(rows.sparkSession)
    i, j = rows.columns.index(text), rows.columns.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, s in zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True):
                w = t.encode().split() if t is not None else []
                gone = {k for lo, hi in s or [] for k in range(lo, hi)}
                new.append(None if t is None else b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
            yield pa.record_batch([pa.array(new, pa.string()) if k == i else c for k, c in enumerate(b.columns)], b.schema.names)

    return rows.mapInArrow(run, rows.schema)
