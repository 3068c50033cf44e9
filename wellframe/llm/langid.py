"""Language of every word and text by a linear-chain conditional random field.

A word's emission score for a language sums the weights of its hashed features: the word itself (lexicon),
its first one to four bytes and all byte trigrams, of which the last ones are its suffixes (affixes).  Learned
transitions tie neighbouring words; forward-backward gives each word's posterior, so that code-switched texts get
labelled word by word.  A text's language is that with the largest summed posterior, its score the share.

Forward-backward is exact for texts of any length and vectorised over all blocks of a batch: the transfer
matrices of blocks of words are multiplied first, then messages pass from block to block, then within them.

Training: ``docs_per_label`` distinct texts of each label, up to ``chars_per_doc`` of each (bounds on the sample, not on
what is labelled), plus splices of two texts of different languages, from which switching is learned.  Copies count once.  The loss is the exact negative log-likelihood with AdaGrad steps.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0; so does every text if nothing was
there to learn from.  Rows with a null label aren't learned from.  Repeated rows are judged one by one; ties go to
the label that sorts first.  Other columns are neither read nor returned, except by ``keep_known``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellframe.llm.staging import discard, free_memory, small_batches, staged
from wellframe.llm.words import Words, blocks, mix

UNKNOWN = "und"
TABLE_BITS = 17
PREFIXES = (1, 2, 3, 4)
GRAM = 3
BLOCK = 32
#: Words after which products are scaled: eight steps stay far above the smallest double.
SCALE = 4


@dataclass
class Model:
    labels: list[str]
    #: feature weights, 2**TABLE_BITS x labels
    weights: np.ndarray
    #: transition scores from row to column
    transitions: np.ndarray


def feature_ids(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each word's lexicon and prefix features (words x 5), of its trigrams, and where these begin."""
    shift = np.uint64(64 - TABLE_BITS)
    fixed = [mix(w.span_hash(w.start, w.end), 1) >> shift]
    for n in PREFIXES:
        fixed.append(mix(w.span_hash(w.start, np.minimum(w.start + n, w.end)), 10 + n) >> shift)
    size = w.end - w.start
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(w.start - begin, size)
    grams = mix(w.span_hash(at, np.minimum(at + GRAM, np.repeat(w.end, size))), 20) >> shift
    return np.stack(fixed, axis=1).astype(np.int64), grams.astype(np.int64), begin


def emissions(ids: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    fixed, grams, begin = ids
    out = np.empty((len(begin), weights.shape[1]), weights.dtype)
    for k in range(weights.shape[1]):
        out[:, k] = np.add.reduceat(weights[:, k].take(grams), begin) if len(begin) else 0
    for k in range(fixed.shape[1]):
        out += weights.take(fixed[:, k], axis=0)
    return out


def marginals(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, count_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words and, if asked for, the expected transition counts; ``first`` bounds the texts in ``e``."""
    n, m = e.shape
    if not n:
        return np.zeros((0, m)), np.zeros((m, m))
    e = e.T.astype(np.float32)
    psi = np.exp(np.maximum(e - e.max(axis=0), np.float32(-30)))  # labels x words
    a = np.exp(np.clip(transitions - transitions.max(), -30, 0))
    # Blocks of at most BLOCK words, none over a text's end; long ones first, so that those with a word k are a prefix.
    size = np.diff(first)
    count = -(-size // BLOCK)
    start = np.cumsum(count) - count
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(start, count)
    begin = first[text] + nth * BLOCK
    length = np.minimum(BLOCK, first[text + 1] - begin)
    by_length = np.argsort(-length, kind="stable")
    place = np.empty_like(by_length)
    place[by_length] = np.arange(len(by_length))
    begin, nth, length = begin[by_length], nth[by_length], length[by_length]
    nb = len(begin)
    live = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")  # blocks with a word k
    at = np.minimum(begin + np.arange(BLOCK)[:, None], n - 1)
    p = psi[:, at].transpose(1, 0, 2).astype(np.float64)  # BLOCK x labels x blocks
    # The transfer matrix of a block: the product of (a * p_t) over its words; scaled now and then.
    t = a[:, :, None] * p[0]
    for k in range(1, BLOCK):
        c = live[k]
        if not c:
            break
        step = (a.T @ t[:, :, :c]) * p[k, :, :c]
        t[:, :, :c] = step / step.max(axis=(0, 1)) if k % SCALE == 0 else step
    t = np.ascontiguousarray((t / t.max(axis=(0, 1))).transpose(2, 0, 1))
    # Messages into each block: forward in order, backward in reverse; texts side by side.
    fwd, bwd = np.empty((nb, m)), np.empty((nb, m))
    order = np.argsort(-count, kind="stable")
    f = np.tile(np.linalg.pinv(a.T) @ np.ones(m), (len(size), 1))  # so that the first word has no transition before it
    g = np.ones((len(size), m))
    for k in range(int(count.max())):
        now = order[: int(np.searchsorted(-count[order], -k, "left"))]
        b = place[start[now] + k]
        fwd[b] = f[now]
        x = np.einsum("ij,ijk->ik", f[now], t[b])
        f[now] = x / np.abs(x).sum(axis=1, keepdims=True)
        b = place[start[now] + count[now] - 1 - k]
        bwd[b] = g[now]
        x = np.einsum("ijk,ik->ij", t[b], g[now])
        g[now] = x / np.abs(x).sum(axis=1, keepdims=True)
    # Within the blocks, all at once.
    alpha = np.empty((BLOCK, m, nb))
    fwd = x = np.ascontiguousarray(fwd.T)
    for k in range(BLOCK):
        c = live[k]
        x = (a.T @ x[:, :c]) * p[k, :, :c]
        if k % SCALE == 0:
            x /= np.abs(x).sum(axis=0)
        alpha[k, :, :c] = x
    post = np.empty((m, n))
    pairs = np.zeros((m, m))
    x = np.ascontiguousarray(bwd.T)
    for k in range(BLOCK - 1, -1, -1):
        c = live[k]
        if not c:
            continue
        q = alpha[k, :, :c] * x[:, :c]
        post[:, begin[:c] + k] = q / q.sum(axis=0)
        y = p[k, :, :c] * x[:, :c]
        if count_pairs:
            use = slice(None) if k else nth[:c] > 0
            joint = (alpha[k - 1, :, :c] if k else fwd)[:, None, use] * a[:, :, None] * y[None, :, use]
            pairs += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
        y = a @ y
        x[:, :c] = y / y.sum(axis=0) if k % SCALE == 0 else y
    return post.T, pairs


def train(docs: DataFrame, text: str, label: str, learn: Column | None = None, docs_per_label: int = 250, chars_per_doc: int = 20_000, epochs: int = 4, seed: int = 7) -> Model:
    """Learn from the rows that satisfy ``learn`` and have a label.

    The sample: of each label the ``docs_per_label`` distinct texts of smallest hash, whatever their length; of a longer one
    the first ``chars_per_doc`` characters are a training sequence.  What is labelled is never cut.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.select(F.col(label).cast("string").alias("y"), F.xxhash64(text, F.lit(9)).alias("h"), F.col(text).alias("t"))
    # Hashes alone are moved.  They are even, so some four times as many as are wanted lie below a bound: these are ordered.
    hashes = staged(rows.select("y", "h").distinct(), "hashes")
    sizes = {r.y: r["count"] for r in hashes.groupBy("y").count().collect()}  # one for each language
    if not sizes:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    share = F.create_map(*[F.lit(v) for y, c in sizes.items() for v in (y, min(1.0, 4 * docs_per_label / c))])
    low = hashes.where((F.col("h").cast("double") / 2.0**64 + 0.5 < share[F.col("y")]) | (share[F.col("y")] == 1.0))
    first = Window.partitionBy("y").orderBy("h")
    drawn = staged(low.withColumn("r", F.row_number().over(first)).where(F.col("r") <= docs_per_label).select("y", "h"), "drawn")
    texts = rows.join(F.broadcast(drawn), ["y", "h"], "left_semi")  # so many hashes of each label
    cut = F.substring("t", 1, chars_per_doc)
    sample = texts.groupBy("y", "h").agg(F.first(cut).alias("t")).orderBy("h", "y").collect()
    discard(hashes, drawn)
    return fit([r.t for r in sample], [r.y for r in sample], epochs, seed)


def fit(texts: list[str], langs: list[str], epochs: int = 4, seed: int = 7, batch_words: int = 12_000, rate: float = 0.2) -> Model:
    """AdaGrad on the exact gradient; each batch mixes whole texts and splices of two languages."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    m = len(labels)
    y = np.array([labels.index(x) for x in langs])
    words = [[] for _ in texts]
    for lo, hi, w in blocks(pa.array(texts, pa.string())):
        for i in range(hi - lo):
            words[lo + i] = [w.text(k) for k in range(w.first[i], w.first[i + 1])]
    keep = [i for i in range(len(texts)) if words[i]]
    model = Model(labels, np.zeros((1 << TABLE_BITS, m), np.float32), np.zeros((m, m)))
    if not keep:
        return model
    gw, ga = np.full(model.weights.shape, 1e-2, np.float32), np.full((m, m), 1.0)
    for _ in range(epochs):
        order = rng.permutation(keep)
        at = 0
        while at < len(order):
            seqs, size = [], 0
            while at < len(order) and size < batch_words:
                i = int(order[at])
                at += 1
                seqs.append(([*words[i]], [y[i]] * len(words[i])))
                size += len(words[i])
                if m > 1 and rng.random() < 0.3:  # a span of this text within a span of another
                    j = int(rng.choice(keep))
                    a, b = sorted(rng.integers(0, len(words[i]) + 1, 2))
                    c, d = sorted(rng.integers(0, len(words[j]) + 1, 2))
                    mixed = words[i][:a] + words[j][c:d] + words[i][b:]
                    if mixed:
                        seqs.append((mixed, [y[i]] * a + [y[j]] * (d - c) + [y[i]] * (len(words[i]) - b)))
                        size += len(mixed)
            w = next(blocks(pa.array([b" ".join(x for s, _ in seqs for x in s).decode("utf-8", "replace")]), 1 << 40))[2]
            gold = np.concatenate([np.array(t) for _, t in seqs])
            if len(gold) != len(w):
                continue
            first = np.concatenate([[0], np.cumsum([len(s) for s, _ in seqs])])
            ids = feature_ids(w)
            post, pairs = marginals(emissions(ids, model.weights), first, model.transitions)
            post[np.arange(len(gold)), gold] -= 1.0
            seen = np.zeros((m, m))
            inside = np.ones(len(gold), dtype=bool)
            inside[first[:-1]] = False
            np.add.at(seen, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
            g = np.empty_like(model.weights)
            size_of = np.diff(np.append(ids[2], len(ids[1])))
            flat = np.concatenate([*ids[0].T, ids[1]])
            rows = np.concatenate([np.tile(np.arange(len(gold)), ids[0].shape[1]), np.repeat(np.arange(len(gold)), size_of)])
            for k in range(m):
                g[:, k] = np.bincount(flat, weights=post[rows, k], minlength=len(g))
            g = g / len(gold) * 100 + 1e-4 * model.weights
            gw += g * g
            model.weights -= (rate * g / np.sqrt(gw)).astype(np.float32)
            h = (pairs - seen) / len(gold) * 100 + 1e-3 * model.transitions
            ga += h * h
            model.transitions -= rate * h / np.sqrt(ga)
    return model


def has_letter(low: np.ndarray) -> bool:
    """Whether lower-cased UTF-8 bytes hold a letter of any script."""
    if ((low >= 0x61) & (low <= 0x7A)).any():
        return True
    return bool((low >= 0x80).any()) and any(c.isalpha() for c in low.tobytes().decode("utf-8", "replace"))


def judged(texts: pa.Array, model: Model, detail: bool = False) -> Iterator[tuple[str, float, list]]:
    """For each text its label, its score, and with ``detail`` its runs of one language (label, first word, after last)."""
    m = len(model.labels)
    for lo, hi, w in blocks(texts):
        post = marginals(emissions(feature_ids(w), model.weights), w.first, model.transitions, False)[0] if m and len(w) else np.zeros((len(w), max(m, 1)))
        sums = np.concatenate([np.zeros((1, max(m, 1))), np.cumsum(post, axis=0)])
        total = sums[w.first[1:]] - sums[w.first[:-1]]
        best = total.argmax(axis=1)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if not m or a == b or not has_letter(w.low[w.offsets[i] : w.offsets[i + 1]]):
                yield UNKNOWN, 0.0, []
                continue
            runs = []
            if detail:
                own = post[a:b].argmax(axis=1)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [b - a]])
                runs = [(model.labels[own[x]], int(x), int(z)) for x, z in zip(cut[:-1], cut[1:], strict=True)]
            yield model.labels[best[i]], min(1.0, float(total[i, best[i]]) / (b - a)), runs


def predict(docs: DataFrame, key: str, text: str, model: Broadcast, detail: bool = False) -> DataFrame:
    """key, lang_pred, score, and runs: array of (label, first word, word after the last) with ``detail``."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    run_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(judged(b.column(1), model.value, detail))
            runs = [[dict(zip(("label", "first_word", "end_word"), x, strict=True)) for x in g[2]] for g in got]
            yield pa.record_batch([b.column(0).cast(key_type), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(runs, run_type)], ["key", "lang_pred", "score", "runs"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, runs array<struct<label:string,first_word:bigint,end_word:bigint>>")
    return out.withColumnRenamed("key", key)


def keep_known(docs: DataFrame, text: str, model: Broadcast, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, in all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s, _ in judged(b.column(at), model.value)], pa.bool_()))
        free_memory()

    return docs.mapInArrow(run, docs.schema)
