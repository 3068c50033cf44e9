"""URL filter by a sort-merge range join with a stack of active rules.

A host is turned round, so that a host suffix becomes a key prefix and hence an interval of sorted keys:
``example.org`` is ``org.example.``, and it and its subdomains are the keys from there up to
``org.example/``, as ``/`` follows ``.``.  URLs and rules are cut into the same key ranges; each range is
swept once in key order, with a stack of the nested host intervals that are open at the moment.  An open
interval has its own sorted path prefixes.  Rules are never collected whole: a range gets those that begin
in it, and those that reach into it from before.

The longest rule wins: the longer host, and for one host the longer path.  Rules equal in both: block wins.

Edge cases: a null URL or one without ``://`` has an empty host and path, and no rule fits it unless a rule's
host and path are empty.  Rows with a null in any column are judged; repeated rows are judged one by one.
An empty rules table gives every URL the default verdict; an empty URL table gives no rows.
Columns of the URL table other than key and url are not read or returned.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys sampled to place the cuts, for each range: what the driver gets is bounded by ranges x this.
SAMPLE_PER_RANGE = 40


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each ended by a dot: a subdomain's key begins with its parent's."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def reverse_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Sweep:
    """Rules that are open at the current key.  Rules and URLs must come in key order, a rule before equal URLs."""

    def __init__(self) -> None:
        #: (host key, [(path, rule, verdict)] sorted by path)
        self.stack: list[tuple[str, list[tuple[str, str, str]]]] = []

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, []))
        rules = self.stack[-1][1]
        rules.insert(bisect_right(rules, (path, rule, verdict)), (path, rule, verdict))

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.close(key)
        for _, rules in reversed(self.stack):
            found = self._longest(rules, path)
            if found:
                return found
        return None

    @staticmethod
    def _longest(rules: list[tuple[str, str, str]], path: str) -> tuple[str, str] | None:
        """The longest rule path that ``path`` starts with: a binary search for ever shorter common prefixes."""
        probe = path
        while True:
            i = bisect_right(rules, (probe, "\U0010ffff", "")) - 1
            if i < 0:
                return None
            p, rule, _ = rules[i]
            if path.startswith(p):
                return rules[i][1], rules[i][2]
            n = 0
            while n < len(p) and n < len(probe) and p[n] == probe[n]:
                n += 1
            probe = path[:n]


def filter_urls(urls: DataFrame, key: str, url: str, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """key, host, path, rule, verdict of every URL.

    ``rules``: columns host, path, verdict (allow or block).  ``ranges``: how many key ranges to cut; by
    default as many as shuffle partitions.  Equal keys are told apart by a hash of the row, so one very
    common host or URL is spread over several ranges.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col(url))
    rows = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hk", reversed_host(F.col("host"))).withColumn("salt", F.hex(F.xxhash64("key", "host", "path", F.lit(7))))
    rules = rules.select(F.lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.select(reversed_host(F.col("host")).alias("hk"), "path", F.concat("host", "path").alias("rule"), "verdict")
    rules = rules.groupBy("hk", "path").agg(F.min(F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1).alias("o"), "verdict", "rule")).alias("best"))
    rules = rules.select("hk", "path", "best.rule", "best.verdict")

    # Cut points: a sample whose size depends on the number of ranges alone.
    n = rows.count()
    rate = min(1.0, SAMPLE_PER_RANGE * ranges / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("salt", F.lit(11)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select(F.concat_ws("\x00", "hk", "salt")).limit(4 * SAMPLE_PER_RANGE * ranges)
    keys = sorted(r[0].encode() for r in sample.collect())
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hk, salt = b.column("hk").to_pylist(), b.column("salt").to_pylist()
            at = [bisect_right(cuts, f"{h}\x00{s}".encode()) for h, s in zip(hk, salt, strict=True)]
            none = pa.nulls(b.num_rows, pa.string())
            yield pa.record_batch([pa.array(at, pa.int32()), b.column("hk"), pa.array([1] * b.num_rows, pa.int32()), b.column("key"), b.column("host"), b.column("path"), none, none], names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            at: list[int] = []
            for k, p, r, v in zip(*(b.column(c).to_pylist() for c in ("hk", "path", "rule", "verdict")), strict=True):
                # The interval of a host key runs up to the key with its last dot raised to the next character.
                first = bisect_right(cuts, k.encode())
                last = bisect_right(cuts, k[:-1].encode() + b"/") if k else len(cuts)
                for i in range(first, last + 1):
                    at.append(i)
                    for o, x in zip(out, (k, p, r, v), strict=True):
                        o.append(x)
            s = [pa.array(o, pa.string()) for o in out]
            yield pa.record_batch([pa.array(at, pa.int32()), s[0], pa.array([0] * len(at), pa.int32()), pa.nulls(len(at), key_type), pa.nulls(len(at), pa.string()), s[1], s[2], s[3]], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind, key_type = urls.schema[key].dataType.simpleString(), to_arrow_type(urls.schema[key].dataType)
    names = ["range", "hk", "is_url", "key", "host", "path", "rule", "verdict"]
    schema = f"range int, hk string, is_url int, key {kind}, host string, path string, rule string, verdict string"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, here = Sweep(), None
        for b in batches:
            k, h, p, r, v = [], [], [], [], []
            for rng, hk, is_url, key_, host_, path_, rule, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rng != here:
                    state, here = Sweep(), rng
                if not is_url:
                    state.open(hk, path_, rule, verdict)
                    continue
                found = state.judge(hk, path_)
                k.append(key_), h.append(host_), p.append(path_), r.append(found and found[0]), v.append(found[1] if found else default)
            yield pa.record_batch([pa.array(k, key_type), *(pa.array(x, pa.string()) for x in (h, p, r, v))], ["key", "host", "path", "rule", "verdict"])

    dealt = rows.select("hk", "salt", "key", "host", "path").mapInArrow(deal_rows, schema).unionByName(rules.mapInArrow(deal_rules, schema))
    swept = dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "hk", "is_url").mapInArrow(sweep, f"key {kind}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("key", key) if key != "key" else swept
