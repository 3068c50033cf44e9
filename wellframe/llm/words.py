"""Vectorised words and rolling hashes over whole Arrow batches of text.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.  Every byte of a
non-ASCII character belongs to a word, so the classes can be read off UTF-8 bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: SQL's spelling of the word pattern, for texts whose A-Z are lower-cased already.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x41:0x5B] = True
_IS_WORD[0x80:] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64, from 0."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class Words:
    """The words of several texts: byte spans, hashes of any byte span, and each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets - offsets[0]
        raw = raw[offsets[0] : offsets[-1]]
        n = len(raw)
        self.low = _LOW[raw]
        inside = _IS_WORD[raw]
        cuts = self.offsets[1:-1]
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[cuts[cuts < n]] = False
        after = np.empty(n, dtype=bool)
        after[n - 1 :] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: first[i] is the index of text i's first word; first[-1] is the number of words.
        self.first = np.searchsorted(self.start, self.offsets)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A polynomial hash modulo 2**64 of the lower-cased bytes in [lo, hi), wherever they stand."""
        n = len(self.low)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self._sums[1:])
        return (self._sums[hi] - self._sums[lo]) * powers(_BASE_INV, n + 1)[lo]

    def hashes(self) -> np.ndarray:
        return mix(self.span_hash(self.start, self.end))

    def text(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo to hi - 1, one space between."""
        return b" ".join([self.text(k) for k in range(lo, hi)])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(texts: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), some ``max_bytes`` at a time; a longer text is alone, whole."""
    raw, offsets = columns(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n), Words(raw, offsets[lo : min(hi, n) + 1])
        lo = hi


def word_hash(words: list[bytes]) -> np.ndarray:
    """The hashes that ``Words.hashes`` gives these (lower-case) words."""
    out = np.zeros(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        out[i] = span_hash_of(w)
    return mix(out)


def span_hash_of(w: bytes) -> int:
    h, p = 0, 1
    for c in w:
        h = (h + (c + 1) * p) & 0xFFFFFFFFFFFFFFFF
        p = (p * _BASE) & 0xFFFFFFFFFFFFFFFF
    return h
