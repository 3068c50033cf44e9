"""Near-duplicates by Order MinHash (Marcais and others, 2019) and banded alignment.

A text's k-mers are its runs of ``k`` consecutive words (a shorter text is one k-mer), each labelled with its
occurrence number, so that repeats are told apart; of one k-mer the first ``repeats`` occurrences are sampled, so that a text
of which much repeats a few words is looked up by the rest of it too.  A sketch takes the ``length`` k-mers of smallest hash and
keeps them in the order of the text: two texts agree in a sketch if they share these k-mers in that order,
which edit-similar texts do more often than texts that merely share words.

Exact copies are one node.  Texts that agree in a sketch are candidates, and a candidate pair is a link if its edit
similarity, 1 - edits / words of the longer text, is ``least`` or more: the edits (words inserted, deleted or replaced) are
counted by an alignment of the two word sequences within the band that so few edits cannot leave.  Classes are the
connected components of the links.

Within a bucket, however large, pairs aren't enumerated.  Its ``leaders`` most central texts (those whose k-mers are common,
such as an original among its edited copies) are compared with all its texts, which is all pairs of a bucket of up to
``leaders`` + 1 texts.  Larger buckets that still hold several components are joined by an exact prefix filter on two-word
grams, so that every similar pair of a bucket ends in one class.

A pair whose k-mers have Jaccard similarity J is no candidate with a probability of about (1 - J ** length) ** sketches.  Of texts
that differ in a fifth of their words few k-mers of five words are left, so ``FINER`` families of shorter ones look for these
too: at a similarity of 0.8, where J is some 0.2 for five words and 0.34 for three, about 0.06 of the pairs are missed.

The key is an integer.

Edge cases: null texts are alone; equal texts, empty ones too, are copies; texts of equal words that differ in case or
punctuation have similarity 1; a text without a word equals nothing else.  Rows of the same key and text are one text; a key
with several texts joins their classes.  Ties of centrality go to the smaller key.  An empty table gives no rows.  Columns
other than key and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.llm.components import components, joined
from wellframe.llm.staging import discard, free_memory, only, small_batches, staged
from wellframe.llm.words import Words, blocks, mix

_C = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-mer hashes of all texts, in order, and where each text's begin (with the end)."""
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(begin[-1]), dtype=np.uint64)
    if not len(out):
        return out, begin
    h = w.hashes()
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(out)) - begin[doc] + w.first[doc]
    for j in range(k):
        out = out * _C + h[np.minimum(at + j, w.first[doc + 1] - 1)]
    out += n[doc].clip(max=k).astype(np.uint64)
    return mix(out), begin


def labelled(s: np.ndarray, begin: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """k-mers told apart by their occurrence numbers in their text, without those beyond the first ``repeats``."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    key = s ^ mix(doc.astype(np.uint64), 2)
    order = np.argsort(key, kind="stable")  # equal k-mers of a text stand together, in the order of the text
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[order][1:] == key[order][:-1]
    if not same.any():
        return s, begin
    run = np.arange(len(key)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    nth = np.empty(len(key), dtype=np.int64)
    nth[order] = run
    keep = nth < repeats
    out = np.where(nth > 0, mix(s + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 1), s)
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def sketch(s: np.ndarray, begin: np.ndarray, sketches: int, length: int, family: int = 0) -> np.ndarray:
    """Order MinHash of every text that has a k-mer (rows) for each sketch (columns)."""
    full = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros((len(full), sketches), dtype=np.uint64)
    if not len(full):
        return out
    size = np.diff(begin)[full]
    cut = begin[full]
    row = np.repeat(np.arange(len(full)), size)
    for i in range(sketches):
        v = mix(s, 100 + i)
        picks = np.full((len(full), length), len(s), dtype=np.int64)
        for j in range(length):
            low = np.minimum.reduceat(v, cut)
            at = np.flatnonzero((v == low[row]) & (v != _TOP))
            picks[row[at], j] = at
            v[at] = _TOP
        picks.sort(axis=1)  # the order of the text; what a short text lacks comes last
        x = np.full(len(full), i + 1000 * family, dtype=np.uint64)
        for j in range(length):
            some = picks[:, j] < len(s)
            x = x * _C + np.where(some, s[np.minimum(picks[:, j], len(s) - 1)], np.uint64(j))
        out[:, i] = mix(x)
    return out


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - edits / words of the longer, for two sequences of word hashes; 0 if it is below ``least`` or there are no words."""
    longer = max(len(a), len(b))
    most = allowed_edits(longer, least)
    if not longer or longer - min(len(a), len(b)) > most:
        return 0.0
    for _ in range(2):  # equal ends
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        same = int(differ[0]) if len(differ) else n
        a, b = a[same:][::-1], b[same:][::-1]
    if len(a) < len(b):
        a, b = b, a
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if len(a) - int(np.minimum(ca[x], cb[y]).sum()) > most:  # each word of the longer one without a partner is an edit
        return 0.0
    edits = banded_edits(a.tolist(), b.tolist(), most)
    return 1 - edits / longer if edits <= most else 0.0


def allowed_edits(words: int, least: float) -> int:
    """The most edits that leave a pair, whose longer text has so many words, ``least`` similar."""
    return int((1 - least) * words + 1e-9)


def banded_edits(a: list[int], b: list[int], most: int) -> int:
    """Edits that turn ``a`` into ``b``, or ``most`` + 1 if there are more; ``a`` is no shorter than ``b``.

    Bit vectors hold the steps between neighbours in a column of the table (Myers, 1999), here only of the 2 most + 1
    rows around the diagonal, which the vectors follow by one row for each column (Hyyro, 2003).
    """
    n, m = len(a), len(b)
    most = min(most, n)
    if n - m > most:
        return most + 1
    rows: dict[int, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i + most  # shifted, as the first band begins ``most`` rows above the table
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full ^ ((1 << most) - 1), 0  # where a column grows or falls by one; rows above the table are level
    cost = most  # of the band's lowest cell in the table
    for j, c in enumerate(b):
        equal = rows.get(c, 0) >> j & full
        level = (((equal & up) + up) ^ up | equal | down) & full  # cells that cost no more than their upper left neighbour
        right_up = down | full & ~(level | up)
        right_down = level & up
        if j + most < n:  # the lowest cell moves along the diagonal, then along the last row
            cost += not level >> (width - 1)
        else:
            at = n - 1 - j + most
            cost += (right_up >> at & 1) - (right_down >> at & 1)
        if cost > 2 * most + m - n:
            return most + 1
        level >>= 1
        up = right_down | full & ~(level | right_up)
        down = level & right_up
    return min(cost, most + 1)


#: Bins that a text's words are counted in; counts stop at 255.
BINS = 256


def histograms(w: Words, h: np.ndarray) -> np.ndarray:
    """The word counts of every text (rows) by bin (columns)."""
    n = len(w.first) - 1
    cells = np.bincount(w.doc_of_word() * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), minlength=n * BINS)
    return cells.clip(max=255).astype(np.uint8).reshape(n, BINS)


#: Further k-mers: their words, and the words of the texts that they are taken of (from, below).  Two texts of which the longer has
#: 40 words or more have 32 or more each if they are 0.8 similar, so no pair falls between the families.
FINER = ((2, 0, 40), (3, 24, 1 << 62))


def families(w: Words, k: int, sketches: int, finer: int, length: int, repeats: int) -> list[list[int]]:
    """Every text's sketches, of k-mers of ``k`` words and of the FINER ones for its length; told apart by their seeds."""
    out: list[list[int]] = [[] for _ in range(len(w.first) - 1)]
    size = np.diff(w.first)
    for words, low, high, number in ((k, 0, 1 << 62, sketches), *((*f, finer) for f in FINER)):
        s, begin = labelled(*kmers(w, words), repeats)
        asked = (size >= low) & (size < high) & (np.diff(begin) > 0)
        if not number or not asked.any():
            continue
        if not asked.all():  # the k-mers of the other texts go
            kept = np.repeat(asked, np.diff(begin))
            s, begin = s[kept], np.concatenate([[0], np.cumsum(np.where(asked, np.diff(begin), 0))])
        found = sketch(s, begin, number, length, words).view(np.int64)
        for row, i in zip(found.tolist(), np.flatnonzero(asked).tolist(), strict=True):
            out[i] += row
    return out


def sketched(docs: DataFrame, key: str, text: str, k: int, sketches: int, finer: int, length: int, repeats: int) -> DataFrame:
    """key, digest (null for a null text), n_words, bins, sketches: all that is known of a text without its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rows, bins = [], [], []
            for _, _, w in blocks(b.column(2)):
                n.append(np.diff(w.first))
                rows += families(w, k, sketches, finer, length, repeats)
                bins += [x.tobytes() for x in histograms(w, w.hashes() if len(w) else np.zeros(0, np.uint64))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(bins, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["key", "digest", "n_words", "bins", "sketches"])
        free_memory()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, digest binary, n_words bigint, bins binary, sketches array<bigint>")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (a, b, similarity) of ``pairs`` whose edit similarity is ``least`` or more; nodes: node, bins; texts: key, text.

    Most pairs are refused by their word counts, of which an edit changes one up and one down at most, before texts move.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int16) for i in (2, 3))
            longer = np.maximum(b.column(4).to_numpy(), b.column(5).to_numpy())
            far = np.maximum(np.maximum(x - y, 0).sum(axis=1), np.maximum(y - x, 0).sum(axis=1))
            ok = pa.array(far <= ((1 - least) * longer + 1e-9).astype(np.int64))
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = (x for _, _, w in blocks(batch.column("ta")) for x in _each(w))
            right = (x for _, _, w in blocks(batch.column("tb")) for x in _each(w))
            s = np.array([edit_similarity(x, y, least) for x, y in zip(left, right, strict=True)], dtype=float)
            ok = pa.array(s > 0)
            yield pa.record_batch([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(s[s > 0])], ["a", "b", "similarity"])
        free_memory()

    of = lambda x: nodes.select(F.col("node").alias(x), F.col("bins").alias(f"bins_{x}"), F.col("n_words").alias(f"n_{x}"))
    counted = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "bins_a", "bins_b", "n_a", "n_b")
    some = staged(counted.mapInArrow(likely, f"a {kind}, b {kind}"), "likely")
    known = staged(_once(only(texts, some.select(F.explode(F.array("a", "b")).alias("key")), "key")), "texts")
    full = some.join(known.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(known.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    out = staged(full.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, similarity double"), "links")
    discard(some, known)
    return out


def _once(texts: DataFrame) -> DataFrame:
    """Each text of a key once, however often its row is repeated; repeats go before rows move."""
    return texts.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["key", "_hash"]).drop("_hash")


def _each(w: Words) -> Iterator[np.ndarray]:
    h = w.hashes() if len(w) else np.zeros(0, np.uint64)
    for i in range(len(w.first) - 1):
        yield h[w.first[i] : w.first[i + 1]]


def near_duplicates(docs: DataFrame, key: str, text: str, least: float = 0.8, k: int = 5, sketches: int = 8, finer: int = 20, length: int = 2, leaders: int = 3, repeats: int = 4) -> DataFrame:
    """key, class_id, rep_id of every row: the smallest key of its class and of its exact copies."""
    small_batches(docs.sparkSession)
    known = staged(sketched(docs, key, text, k, sketches, finer, length, repeats), "sketches")
    # Equal texts have equal sketches: one node for them.
    nodes = known.where("digest is not null and key is not null").groupBy("digest").agg(F.min(F.struct("key", "n_words", "bins", "sketches")).alias("r"))
    nodes = staged(nodes.select("digest", F.col("r.key").alias("node"), "r.n_words", "r.bins", "r.sketches"), "nodes")
    members = _members(nodes)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    pairs = _pairs(members, leaders, least)
    links = verified(pairs, nodes, texts, least)
    labels = components(links)
    done = [members, pairs, links]
    # What the leaders of large buckets have left: all similar pairs of different components, by an exact join.
    left = _open(members, labels, leaders)
    if not left.isEmpty():
        more = staged(_prefix_pairs(left, texts, least).join(pairs, ["a", "b"], "left_anti"), "pairs")
        new = verified(more, nodes, texts, least)
        done += [more, new, labels]
        labels = joined(labels, new)
    classes = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.col("node").alias("rep_id"), F.coalesce("label", "node").alias("class_id"))
    classes = staged(classes, "classes")
    discard(left, nodes, labels, *done)
    out = known.select("key", "digest").join(classes, "digest", "left")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("rep_id", "key").alias("rep_id"))


def _members(nodes: DataFrame) -> DataFrame:
    """bucket, node, n_words, central of the nodes that share a bucket with another one.

    central: the summed sizes of a node's buckets.  Sizes are counted before rows move and joined back, by which
    a large bucket is a split join.
    """
    flat = staged(nodes.select("node", "n_words", F.explode("sketches").alias("bucket")), "buckets")
    sizes = staged(flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = staged(flat.join(sizes, "bucket"), "shared")
    central = staged(shared.groupBy("node").agg(F.sum("size").alias("central")), "central")
    out = staged(shared.join(central, "node").select("bucket", "node", "n_words", "central"), "members")
    discard(flat, sizes, shared, central)
    return out


def _pairs(members: DataFrame, leaders: int, least: float) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's most central nodes with its other nodes of similar length."""
    # Spark keeps a task's first few rows of each bucket before any move.
    order = Window.partitionBy("bucket").orderBy(F.desc("central"), "node")
    led = staged(members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= leaders), "leaders")
    both = members.join(led.select("bucket", F.col("node").alias("lead"), F.col("n_words").alias("lead_n")), "bucket")
    both = both.where("node <> lead").where(F.least("n_words", "lead_n") >= least * F.greatest("n_words", "lead_n") - 1e-9)
    out = staged(both.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "pairs")
    discard(led)
    return out


def _open(members: DataFrame, labels: DataFrame, leaders: int) -> DataFrame:
    """bucket, node, label of the buckets of several components that are too large for leaders to have met all pairs."""
    rows = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = staged(rows, "labelled")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    several = staged(sizes.where((F.col("n") > leaders + 1) & (F.col("lo") < F.col("hi"))).select("bucket"), "several")
    out = staged(rows.join(several, "bucket").distinct(), "open")
    discard(rows, several)
    return out


#: Words of the grams of the exact join.  An edit changes so many grams at most.
GRAM = 2
#: Slots that grams are counted in, to take the rare ones first.  Any order gives the same pairs: this one keeps the grams
#: of a passage that many texts share out of the prefixes.
SLOTS = 1 << 18


def shared_grams(words: int, least: float) -> int:
    """Grams, repeats counted, that a pair of similarity ``least`` shares at least, by the words of its longer text."""
    return words - GRAM + 1 - GRAM * allowed_edits(words, least)


def prefix_length(words: int, least: float) -> int:
    """Grams of a text, rare ones first, among which every similar text that shares enough has a gram of its own prefix."""
    grams = max(1, words - GRAM + 1)
    partners = range(words, int(words / least + 1e-9) + 1)
    return min(grams, grams - min(shared_grams(m, least) for m in partners) + 1)


def _prefix_pairs(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of different labels, with all similar pairs of a bucket; members: bucket, node, label.

    All texts' grams are in one order, a repeated one as often as it occurs.  If two texts share c grams, they share one among
    the first n - c + 1 of each.  The shared ones there, and what may follow the last, bound the rest.
    """
    kind = members.schema["node"].dataType.simpleString()
    nodes = staged(members.select("node", "label").distinct(), "open-nodes")
    mask = np.uint64(SLOTS - 1)
    named = nodes.select(F.col("node").alias("key"), "label")
    full = staged(_once(only(texts, named, "key")).join(named, "key").withColumnRenamed("key", "node"), "open-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, _, w in blocks(batch.column("text")):
                n += np.bincount((kmers(w, GRAM)[0] & mask).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["slot", "n"])
        free_memory()

    found = full.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, dtype=np.int64)
    often[found.column("slot").to_numpy()] = found.column("n").to_numpy()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in blocks(batch.column("text")):
                s, begin = kmers(w, GRAM)
                size_of = np.diff(w.first)
                cols = [[np.zeros(0, np.int64)] for _ in range(5)]
                for i in np.flatnonzero(size_of >= GRAM).tolist():
                    x, count = np.unique(s[begin[i] : begin[i + 1]], return_counts=True)
                    order = np.lexsort((x, often[(x & mask).astype(np.int64)]))
                    x, count = x[order], count[order]
                    end = np.cumsum(count)
                    x = x[: int(np.searchsorted(end - count, prefix_length(int(size_of[i]), least), "left"))]  # repeats stand together
                    for c, v in zip(cols, (np.full(len(x), lo + i), np.full(len(x), size_of[i]), end[-1] - end[: len(x)], count[: len(x)], x.view(np.int64)), strict=True):
                        c.append(v)
                rows = pa.array(np.concatenate(cols[0]))
                yield pa.record_batch([batch.column("node").take(rows), batch.column("label").take(rows), *(pa.array(np.concatenate(c)) for c in cols[1:])], ["node", "label", "n", "rest", "count", "gram"])
        free_memory()

    rows = staged(full.mapInArrow(prefixes, f"node {kind}, label {kind}, n bigint, rest bigint, count bigint, gram bigint"), "prefixes")
    # Grams of several components; of the largest one, texts only meet those outside, and only those of a bucket in common.
    parts = staged(rows.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("texts")), "parts")
    main = parts.groupBy("gram").agg(F.max(F.struct("texts", "label")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    shared = staged(rows.join(staged(main.select("gram", F.col("m.label").alias("main")), "main"), "gram"), "shared")
    # As many buckets as sketches at most.
    within = staged(members.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "within")
    shared = staged(shared.join(within, "node"), "shared")
    x = shared.where("label <> main")
    y = shared.select("gram", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("count").alias("cb"), F.col("main").alias("mb"), F.col("buckets").alias("bb"))
    # A pair outside the largest component meets once, from its smaller node.
    met = x.join(y, "gram").where("label <> lb and (lb = mb or node < b) and arrays_overlap(buckets, bb)")
    met = met.where(F.least("n", "nb") >= least * F.greatest("n", "nb") - 1e-9)
    pairs = met.groupBy(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).agg(F.sum(F.least("count", "cb")).alias("c"), F.min(F.least("rest", "rb")).alias("rest"), F.first(F.greatest("n", "nb")).alias("longer"))
    need = F.col("longer") - (GRAM - 1) - GRAM * F.floor((1 - least) * F.col("longer") + 1e-9)
    out = staged(pairs.where(F.col("c") + F.col("rest") >= need).select("a", "b"), "met")
    discard(nodes, full, rows, parts, shared, within)
    return out
