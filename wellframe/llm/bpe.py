"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Edge cases: a null or empty text has no ids and decodes to no bytes.  Only the key and text columns are
read, so other columns, whatever their names, change nothing and are not returned.  Repeated rows are
encoded one by one.  An empty table gives an empty table.  A long text is cut at safe boundaries and
encoded piece by piece, with the ids of the whole; nothing is truncated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.llm.staging import free_memory, small_batches

#: A rank file is broadcast, so its size is checked first.
MAX_RANK_BYTES = 64 << 20
#: Longer texts (in characters) are cut; the regex and merge buffers then stay small.
PIECE_CHARS = 1 << 16


class Codec:
    """A tiktoken encoding of a rank file's bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self._enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: White space after something else: no alternative of the pattern reaches over it, and none looks back.
        self._safe = regex.compile(r"(?<=\S)(?=\s)")

    def pieces(self, text: str, size: int = PIECE_CHARS) -> Iterator[str]:
        lo = 0
        while len(text) - lo > size:
            cut = self._safe.search(text, lo + size)
            if cut is None:
                break
            yield text[lo : cut.start()]
            lo = cut.start()
        yield text[lo:] if lo else text

    def encode(self, text: str | None, size: int = PIECE_CHARS) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) <= size:
            return self._enc.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return b"".join(self.encode(p, len(p)) for p in self.pieces(text, size))

    def decode(self, ids: bytes | None) -> bytes:
        import numpy as np

        return self._enc.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()) if ids else b""


def load_ranks(spark: SparkSession, path: str) -> Broadcast:
    """Broadcast a rank file; its size is bounded by MAX_RANK_BYTES."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file over {MAX_RANK_BYTES} bytes: {path}")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, key: str, text: str, ranks: Broadcast, pattern: str) -> DataFrame:
    """key, n_tokens (long), ids (binary: little-endian uint32) of every whole text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str, ranks: Broadcast, pattern: str, out: str = "decoded") -> DataFrame:
    """The columns of ``df`` and ``out``: the raw bytes that the ids stand for, UTF-8 or not."""
    names = df.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([codec.decode(i) for i in b.column(at).to_pylist()], pa.binary())], [*names, out])

    return df.mapInArrow(run, df.select(*[c for c in names]).withColumn(out, F.lit(None).cast("binary")).schema)


def round_trip(df: DataFrame, key: str, text: str, ranks: Broadcast, pattern: str) -> DataFrame:
    """key, n_tokens, ids, decoded: ``encode`` and ``decode`` in one pass, by one Python worker for each task instead of two."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.binary())], ["key", "n_tokens", "ids", "decoded"])
        free_memory()

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("key", key)


def text_of(decoded: Column) -> Column:
    """Decoded bytes as text."""
    return F.decode(decoded, "UTF-8")
