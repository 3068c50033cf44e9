"""WARC archives: writing, normalising monolithic gzip files, and reading back by a sidecar index.

A monolithic archive is one gzip member around a whole WARC file, so that no record can be reached without
inflating all before it.  ``normalise`` inflates such a file once, as a stream, writes every record as a
gzip member of its own, and beside it an index of (offset, length) with a few headers.  ``read_records``
then opens single members by their offsets.

Archives are cut at ``max_bytes`` of inflated content, so a file's size does not grow with the corpus.  File
names hold a random run id, the partition and the attempt, and only files named by a finished task's rows
are read: a retried or speculative task never mixes with another's files.

Edge cases: a null payload is an empty one.  A null URL has no target header; line breaks in a URL are
percent-encoded.  Null, empty and repeated keys come back as they are.  Repeated rows are records of their own; where they share the smallest id of a group of
equal payloads, each of them is a response, as none can refer to itself.  A null id counts as larger than
all others.  An empty table gives no archives and no records.  Other columns are not read.  A file that
ends within a record raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import delete, discard, new_dir, small_batches, staged

MAX_ARCHIVE_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(path: str):
    """A file system that all executors share, and the path in it; URIs as pyarrow knows them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Write a whole file under a name that nobody else uses."""
    fs, p = filesystem(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(data)


def record(kind: str, key: str | None, url: str | None, digest: str, length: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header alone.

    Its id is its own, as keys may be null or repeated; the key stands in a header, which a null key lacks.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if key is not None:
        head.append("X-Page-Key: " + quote(key, safe=""))
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    if refers_to is not None:
        head += ["X-Refers-To-Key: " + quote(refers_to, safe=""), f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """A record's headers, by lower-case name, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}, end + 4


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, as a stream."""
    z, open_ = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            open_ = True
            out = z.decompress(chunk)
            if out:
                yield out
            chunk = b""
            if z.eof:
                chunk, open_ = z.unused_data.lstrip(b"\0"), False
                z = zlib.decompressobj(31)
    if open_:
        raise ValueError("the gzip stream ends early")


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated WARC stream; no more than one record and one chunk are held."""
    buf, parts, need = b"", [], 0
    for chunk in stream:
        if need > len(chunk):  # within a large record
            parts.append(chunk)
            need -= len(chunk)
            continue
        buf = b"".join([*parts, chunk])
        parts = []
        while True:
            end = buf.find(b"\r\n\r\n")
            if end < 0:
                need = 0
                break
            head, at = headers(buf[: end + 4])
            size = at + int(head["content-length"]) + 4
            if len(buf) < size:
                need = size - len(buf)
                break
            yield buf[:size]
            buf = buf[size:]
        parts, buf = [buf], b""
    if any(parts):
        raise ValueError("the archive ends within a record")


def deduplicated(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """key, url, payload, length, sha1, kind, refers_to: of equal payloads the smallest key is the response.

    Only payloads that occur more than once are joined back; Spark broadcasts them if their table is small,
    or else splits the sort-merge join's hot keys.
    """
    data = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), data.alias("payload"), F.octet_length(data).cast("bigint").alias("length"), F.sha1(data.cast("binary")).alias("sha1"))
    firsts = rows.groupBy("sha1").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha1").alias("group_sha1"), "first")
    both = rows.join(staged(firsts, "firsts"), (F.col("sha1") == F.col("group_sha1")) & (F.col("length") >= min_bytes), "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return both.select("key", "url", "payload", "length", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", max_bytes: int = MAX_ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write the rows of ``deduplicated`` as monolithic archives; path and n_records of each."""
    run_id = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        stem = f"{folder}/{run_id}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        done: list[tuple[str, int]] = []
        out: list[bytes] = []
        z, size, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0

        def close() -> None:
            nonlocal out, z, size, n
            if n:
                path = f"{stem}-{len(done):05d}.warc.gz"
                put(path, b"".join([*out, z.flush()]))
                done.append((path, n))
            out, z, size, n = [], zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0

        for b in batches:
            for key, url, payload, length, sha1, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(kind, None if key is None else str(key), url, digest, length, payload.encode() if kind == "response" else b"", None if refers is None else str(refers), date)
                out.append(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= max_bytes:
                    close()
        close()
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    return rows.mapInArrow(run, "path string, n_records bigint")


def normalise(archives: DataFrame, folder: str, level: int = 3, chunk: int = 1 << 20) -> DataFrame:
    """Rewrite each archive of column ``path`` with a member for each record; path, index and n_records of the new ones."""
    run_id = uuid.uuid4().hex[:12]

    def read(path: str) -> Iterator[bytes]:
        fs, p = filesystem(path)
        with fs.open_input_stream(p, compression=None) as f:
            while data := f.read(chunk):
                yield data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".warc")
                new = f"{folder}/{run_id}-{attempt}-{name}"
                members, index, at = [], [], 0
                for data in split_records(inflate(read(path))):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(data) + z.flush()
                    head, _ = headers(data[: data.index(b"\r\n\r\n") + 4])
                    index.append(json.dumps({"archive": f"{new}.warc.gz", "offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"], "digest": head.get("warc-payload-digest")}))
                    members.append(member)
                    at += len(member)
                put(f"{new}.warc.gz", b"".join(members))
                put(f"{new}.idx", "".join(x + "\n" for x in index).encode())
                rows.append((f"{new}.warc.gz", f"{new}.idx", len(index)))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "index", "n_records"])

    return archives.select("path").mapInArrow(run, "path string, index string, n_records bigint")


def read_records(normalised: DataFrame) -> DataFrame:
    """Every record of normalised archives, each member opened by its own offset and its payload verified.

    Columns: record_id (the page's key), target_uri, record_type, payload_digest, payload_bytes, refers_to, payload (null for
    a revisit).  ValueError if a payload doesn't match its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index in b.column(0).to_pylist():
                fs, p = filesystem(index)
                with fs.open_input_stream(p, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                if not entries:
                    continue
                fs, p = filesystem(entries[0]["archive"])
                with fs.open_input_file(p) as f:
                    for lo in range(0, len(entries), 256):
                        rows = []
                        for e in entries[lo : lo + 256]:
                            f.seek(e["offset"])
                            rows.append(_parsed(zlib.decompress(f.read(e["length"]), 31)))
                        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    names = ["record_id", "target_uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return normalised.select("index").mapInArrow(run, "record_id string, target_uri string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary")


def _parsed(data: bytes) -> tuple:
    head, at = headers(data)
    block = data[at : at + int(head["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    length = int(head["warc-payload-length"])
    if payload is not None and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its length or digest")
    key = lambda name: unquote(head[name]) if name in head else None
    return key("x-page-key"), head.get("warc-target-uri"), head["warc-type"], digest, length, key("x-refers-to-key"), payload


def round_trip(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these, and read all records back."""
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    monolithic = new_dir(spark, "warc-mono")
    written = staged(write_monolithic(deduplicated(pages, key, url, payload, min_bytes), monolithic, max_bytes=max_bytes), "archives")
    n = max(1, min(written.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    new = staged(normalise(written.repartition(n), new_dir(spark, "warc")), "normalised")
    delete(spark, monolithic)
    discard(written)
    return read_records(new.repartition(n))
