"""Fill-in-the-middle examples: a text is cut at two units and its middle moved to the end.

Units (lines, words or characters) are found by bit-parallelism on big integers.  A text's UTF-8 bytes are translated to
class masks, one bit for each byte; shifted boolean operations leave one bit at every unit's first byte; ``bit_count`` gives
the number of units, and the bit of a wanted rank is found by halving the mask and counting its lower half, so a text of
any length costs a few passes over a number of as many bits as it has bytes.

Edge cases: a null or empty text has no units, is ``plain`` and comes back as the empty text.  A text that holds a
sentinel is ``plain`` and unchanged.  A null key counts as the empty key in the draw.  Repeated rows draw alike.  An empty
table gives an empty table.  Only the key and text columns are read, so other columns, whatever their names, change nothing and
are not returned.  Texts are never cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import free_memory, small_batches


def _classes(members: bytes) -> bytes:
    """A table for ``bytes.translate``: 1 for members, 0 for other bytes."""
    table = bytearray(b"0" * 256)
    for m in members:
        table[m] = 49
    return bytes(table)


_BREAK = _classes(b"\n")
_SPACE = _classes(b" \t\n\v\f\r")
_CONTINUATION = _classes(bytes(range(0x80, 0xC0)))


def mask(text: bytes, table: bytes) -> int:
    """Bit i says whether byte i is in the class."""
    return int(text.translate(table)[::-1] or b"0", 2)


def characters(text: bytes) -> int:
    """The first bytes of code points."""
    return mask(text, _CONTINUATION) ^ ((1 << len(text)) - 1)


def lines(text: bytes) -> int:
    """The first bytes of ``[^\\n]*\\n|[^\\n]+``: the text's first, and every one after a line break."""
    return ((mask(text, _BREAK) << 1) | 1) & ((1 << len(text)) - 1)


def words(text: bytes) -> int:
    """The first bytes of words with the white space after them; the first unit begins the text."""
    full = (1 << len(text)) - 1
    space = mask(text, _SPACE)
    return ((~space & (space << 1)) | 1) & full


UNITS = {"line": lines, "word": words, "char": characters}


def select(bits: int, rank: int) -> int:
    """The place of the set bit with ``rank`` set bits below it, by halving; ``bits`` has more than ``rank``."""
    place, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            rank, bits, place, width = rank - n, bits >> half, place + half, width - half
    return place


def cut(bits: int, size: int, rank: int) -> int:
    """The byte before which ``rank`` units lie, of ``size`` bytes."""
    return size if rank >= bits.bit_count() else select(bits, rank)


@dataclass(frozen=True)
class Format:
    """How examples are drawn and written; rates are percentages of the documents, and of those transformed."""

    unit: str = "line"
    seed: str = "7"
    transform_rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def ambiguous(f: Format) -> bool:
    """Whether a text's end and a sentinel, or a sentinel and a text's start, could make another sentinel."""
    all_ = (f.prefix, f.suffix, f.middle)
    return any(y.startswith(x[i:]) or y.endswith(x[:i]) for x in all_ for y in all_ for i in range(1, len(x))) or not all(all_) or len(set(all_)) < 3


def draws(key: str, seed: str) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def rearranged(text: bytes, draw: tuple[int, int, int, int], f: Format) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix and of the middle, output)."""
    starts = UNITS[f.unit](text) if text else 0
    n = starts.bit_count()
    p, s, m = f.prefix.encode(), f.suffix.encode(), f.middle.encode()
    if not text or p in text or s in text or m in text or draw[2] % 100 >= f.transform_rate:
        return n, "plain", None, None, text
    first, second = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    a, b = cut(starts, len(text), first), cut(starts, len(text), second)
    heads = characters(text)
    before = (heads & ((1 << a) - 1)).bit_count()
    within = ((heads >> a) & ((1 << (b - a)) - 1)).bit_count()
    if draw[3] % 100 < f.spm_rate:
        return n, "spm", before, within, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", before, within, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def transform(docs: DataFrame, key: str, text: str, f: Format = Format()) -> DataFrame:
    """key, n (long), form, prefix_chars, middle_chars (longs), output (string) of every row."""
    small_batches(docs.sparkSession)
    if f.unit not in UNITS:
        raise ValueError(f"unknown unit: {f.unit}")
    if ambiguous(f):
        raise ValueError("an end of one sentinel begins another one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            hs = zip(*(b.column(2 + i).to_pylist() for i in range(4)), strict=True)
            rows = [rearranged(t or b"", h, f) for t, h in zip(texts, hs, strict=True)]
            n, form, before, within, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(out, pa.binary())], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])
        free_memory()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(key, f.seed))])
    out = rows.mapInArrow(run, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.withColumnRenamed("key", key).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, f: Format = Format()) -> Column:
    """The text before ``transform``.  No part holds a sentinel, nor do a part and the sentinel after it make another one."""
    quoted = "|".join("\\Q" + x + "\\E" for x in (f.prefix, f.suffix, f.middle))
    parts = F.split(output, quoted, -1)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)
