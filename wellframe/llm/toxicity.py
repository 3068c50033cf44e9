"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts, over labelled rows, the texts of each class in which a token occurs: a word, or a word's
first four, five or six bytes, which carry over to unseen forms.  A token's score is its log-odds ratio under
a Dirichlet prior of ``prior_texts`` texts, shared among the classes by their sizes.  It is kept where it stands
out of what chance would give the largest of so many tokens; every other word scores a small negative drift.  A linear-time scan (Ruzzo and Tompa, 1999) then finds all maximal
segments of a text, of which those with an E-value below ``max_evalue`` are toxic passages.  E-values follow the
extreme-value law of Karlin and Altschul, whose lambda solves sum p_i exp(lambda s_i) = 1 over the clean
class and whose K is fitted to its maxima.  A logistic curve maps a text's best and summed significance to
a score between 0 and 1.

Bounds: counts come from at most about ``sample_rows`` labelled rows (a hash of the key picks them), the lexicon
has at most ``lexicon_size`` tokens, and the curve is fitted on at most ``curve_texts`` distinct texts of each class, which
are chosen by their hashes among these rows.  Scoring covers every text whole.

Edge cases: null or empty texts, and texts without words, have no segment and the lowest score.  Rows with a
null label or key are not trained on.  Without a labelled text of each class the lexicon is empty and every
score is 0.  Repeated rows are scored one by one and counted as often as they occur in the sample; the curve sees a repeated
text once, with its number.  Columns of the
same name in texts and labels don't clash: only the named ones are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellframe.llm.staging import discard, free_memory, small_batches, staged
from wellframe.llm.words import Words, blocks, mix

PREFIXES = (6, 5, 4)
DRIFT = -0.15


@dataclass
class Model:
    """A lexicon for words and one for each prefix length, and the calibration."""

    keys: list[np.ndarray] = field(default_factory=list)
    scores: list[np.ndarray] = field(default_factory=list)
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, ...] = ()
    max_evalue: float = 0.05


def token_hashes(w: Words) -> list[np.ndarray]:
    """Hashes of all words, and of the prefixes of the words that are longer than these (0 for the rest)."""
    out = [w.hashes()]
    size = w.end - w.start
    for n in PREFIXES:
        h = mix(w.span_hash(w.start, np.minimum(w.start + n, w.end)), n)
        out.append(np.where(size >= n, h, np.uint64(0)))
    return out


def word_scores(w: Words, model: Model) -> np.ndarray:
    """A score for each word: its own, or else that of its longest known prefix, or else the drift."""
    score = np.full(len(w), DRIFT)
    open_ = np.ones(len(w), dtype=bool)
    for h, keys, values in zip(token_hashes(w), model.keys, model.scores, strict=True):
        if len(keys) and open_.any():
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = open_ & (keys[at] == h)
            score[found] = values[at[found]]
            open_ &= ~found
    return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after last, sum), left to right; linear time.

    Only the positive scores are visited: what lies between two of them is one negative step of a running sum.
    """
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # [first, after last, sum before, sum after, nearest earlier one with a smaller sum before]
    for i in hot.tolist():
        new = [i, i + 1, float(sums[i]), float(sums[i + 1]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def features(w: Words, model: Model) -> Iterator[tuple[list[tuple[int, int, float, float]], float, float]]:
    """For each text: its significant segments (first, after last, score, E-value), best and summed significance."""
    scores = word_scores(w, model)
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        own = scores[a:b]
        out, best, total = [], 0.0, 0.0
        if len(own) and own.max() > 0:
            base = math.log(model.k * len(own))
            for lo, hi, s in segments(own):
                e = base - model.lam * s
                if e < math.log(model.max_evalue):
                    out.append((lo, hi, s, math.exp(e)))
                    total += min(-e, 30.0)
                    best = max(best, min(-e, 30.0))
        yield out, best, total


def _score(model: Model, best: float, total: float) -> float:
    if not model.curve:
        return 0.0
    c = model.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * best + c[2] * math.log1p(total)))))


def train(texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column | None = None, sample_rows: int = 40_000, lexicon_size: int = 20_000, curve_texts: int = 2_000, min_count: int = 4, prior_texts: float = 4.0) -> Model:
    """Learn from the texts whose key has a 0 or 1 in ``labels`` and satisfies ``learn`` (a condition on the key)."""
    small_batches(texts.sparkSession)
    marks = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_key is not null and _y in (0, 1)")
    marks = marks.where(learn) if learn is not None else marks
    n = marks.count()
    rate = min(1.0, sample_rows / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(1 << 20)) < F.lit(math.ceil(rate * (1 << 20))))
    # Some sample_rows marks at most: small enough to broadcast, so that no text is shuffled.  A repeated mark counts once.
    marks = marks.distinct()
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(marks), "_key").select("_y", "text")
    rows = staged(rows, "toxic-sample")
    counts, (n_clean, n_toxic) = _counts(rows)
    model = Model()
    if not n_clean or not n_toxic:
        model.keys, model.scores = [np.zeros(0, np.uint64)] * (1 + len(PREFIXES)), [np.zeros(0)] * (1 + len(PREFIXES))
        return model
    a_clean, a_toxic = (prior_texts * n / (n_clean + n_toxic) for n in (n_clean, n_toxic))
    counts = counted = staged(counts.where(F.col("clean") + F.col("toxic") >= min_count), "toxic-counts")
    # The largest of v standard normal deviates is about sqrt(2 ln v): beyond that, chance explains none.
    z = max(2.5, math.sqrt(2 * math.log(max(counts.count(), 2))))
    odds = lambda x, n, a: F.log((x + a) / (n + prior_texts - x - a + 1e-9))
    counts = counts.withColumn("score", odds(F.col("toxic"), n_toxic, a_toxic) - odds(F.col("clean"), n_clean, a_clean))
    counts = counts.withColumn("z", F.col("score") / F.sqrt(1 / (F.col("toxic") + a_toxic) + 1 / (F.col("clean") + a_clean)))
    # A token that all toxic texts have has endless odds, though half the clean ones may have it too: the shares must differ as well.
    share = lambda x, n, a: F.log((x + a) / (n + prior_texts))
    counts = counts.where(share(F.col("toxic"), n_toxic, a_toxic) - share(F.col("clean"), n_clean, a_clean) >= 1.5)
    kept = counts.where(f"z >= {z} and score >= 1.5").orderBy(F.desc("z"), "kind", "token").limit(lexicon_size).select("kind", "token", "score", "clean").collect()
    for kind in range(1 + len(PREFIXES)):
        own = sorted((r.token & 0xFFFFFFFFFFFFFFFF, r.score) for r in kept if r.kind == kind)
        model.keys.append(np.array([k for k, _ in own], dtype=np.uint64))
        model.scores.append(np.array([min(s, 8.0) for _, s in own]))
    _calibrate(model, rows, (n_clean, n_toxic), curve_texts)
    discard(rows, counted)
    return model


def _counts(rows: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """(kind, token, clean, toxic): how many texts of each class have the token; and the class sizes.

    Each task adds up its own texts first, so a frequent token costs one row for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            got: list[list[np.ndarray]] = [[] for _ in range(1 + len(PREFIXES))]
            for lo, hi, w in blocks(b.column(1)):
                if not len(w):
                    continue
                doc = w.doc_of_word()
                toxic = y[lo:hi][doc].astype(np.uint64)
                for kind, h in enumerate(token_hashes(w)):
                    # One of each token and text: sort by both.
                    order = np.lexsort((doc, h))
                    hs, ds = h[order], doc[order]
                    new = np.ones(len(hs), dtype=bool)
                    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
                    got[kind].append(np.stack([hs[new], toxic[order][new]]))
            for kind, parts in enumerate(got):
                if not parts:
                    continue
                h, t = np.concatenate(parts, axis=1)
                token, at = np.unique(h, return_inverse=True)
                tox = np.bincount(at, weights=t, minlength=len(token)).astype(np.int64)
                both = np.bincount(at, minlength=len(token))
                ok = token != 0
                yield pa.record_batch([pa.array(np.full(int(ok.sum()), kind, np.int32)), pa.array(token[ok].view(np.int64)), pa.array((both - tox)[ok].astype(np.int64)), pa.array(tox[ok])], ["kind", "token", "clean", "toxic"])

    tokens = rows.mapInArrow(run, "kind int, token bigint, clean bigint, toxic bigint")
    sizes = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    return tokens.groupBy("kind", "token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), (sizes.get(0, 0), sizes.get(1, 0))


def _calibrate(model: Model, rows: DataFrame, sizes: tuple[int, int], curve_texts: int) -> None:
    """Lambda and K from clean texts, then the logistic curve, on the ``curve_texts`` distinct texts of each class of smallest hash.

    A text counts as often as it occurs in the sample, and a class as many texts as it has there (``sizes``).
    """
    texts = staged(rows.where("text is not null").groupBy("_y", F.xxhash64("text", F.lit(5)).alias("h")).agg(F.count("*").alias("copies"), F.first("text").alias("text")), "toxic-texts")
    # Hashes are even: some twice as many as are wanted lie below a bound, and these alone are ordered.
    found = {r["_y"]: r["count"] for r in texts.groupBy("_y").count().collect()}
    bound = lambda y: min(1.0, 2 * curve_texts / max(1, found.get(y, 0)))
    below = F.col("h").cast("double") / 2.0**64 + 0.5 < F.when(F.col("_y") == 1, bound(1)).otherwise(bound(0))
    first = Window.partitionBy("_y").orderBy("h")
    ranked = texts.where(below).select("_y", "h").withColumn("r", F.row_number().over(first)).where(F.col("r") <= curve_texts)
    drawn = texts.join(F.broadcast(ranked.select("_y", "h")), ["_y", "h"], "left_semi")  # so many hashes of each class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, copies = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for lo, hi, w in blocks(b.column(2)):
                s = word_scores(w, model)
                for i in range(hi - lo):
                    own = s[w.first[i] : w.first[i + 1]]
                    sums = [x[2] for x in segments(own)]
                    out.append((y[lo + i], copies[lo + i], len(own), max(sums, default=0.0), [float(x) for x in own[own > 0]], sums))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["y", "copies", "n", "best", "hot", "sums"])
        free_memory()

    got = drawn.select("_y", "copies", "text").mapInArrow(run, "y int, copies bigint, n bigint, best double, hot array<double>, sums array<double>").collect()
    discard(texts)
    clean = [r for r in got if r.y == 0]
    if not clean or len(clean) == len(got):
        return  # no curve: every score is 0
    texts_seen = sum(r.copies for r in clean)
    words = sum(r.n * r.copies for r in clean) + 1
    hot = np.array([x for r in clean for x in r.hot] or [4.0])
    weight = np.array([r.copies for r in clean for _ in r.hot] or [0.5]) / words

    def excess(lam: float) -> float:
        return float((weight * np.exp(lam * hot)).sum() + (1 - weight.sum()) * math.exp(lam * DRIFT) - 1)

    lo, hi = 1e-3, 1e-3
    while excess(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    model.lam = max(lo, 0.05)
    # K so that the law gives the observed share of clean texts with any positive segment.
    low = float(hot.min())
    seen = min(0.9, max(sum(r.copies for r in clean if r.best > 0), 0.5) / texts_seen)
    model.k = min(1.0, max(1e-6, -math.log(1 - seen) / (words / texts_seen) * math.exp(model.lam * low)))
    # The curve sees the same features as scoring does.
    x, y = [], []
    for r in got:
        e = [-(math.log(model.k * r.n) - model.lam * s) for s in r.sums if r.n]
        e = [min(v, 30.0) for v in e if v > -math.log(model.max_evalue)]
        x.append([1.0, max(e, default=0.0), math.log1p(sum(e))])
        y.append(r.y)
    copies, of = np.array([r.copies for r in got], dtype=float), np.array(y)
    scale = np.array(sizes) / np.bincount(of, weights=copies, minlength=2)
    model.curve = tuple(_logistic(np.array(x), of.astype(float), copies * scale[of]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Newton's method for a ridge-regularised logistic regression of weighted rows."""
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * c
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(c))
        c -= np.clip(np.linalg.solve(h, g), -5, 5)
    return c


def score(docs: DataFrame, key: str, text: str, model: Broadcast) -> DataFrame:
    """key, score, and the toxic segments (array of first word, word after the last, score, E-value)."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    parts = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for s, segs in judged(b.column(1), model.value):
                scores.append(s)
                found.append([dict(zip(("first_word", "end_word", "score", "evalue"), x, strict=True)) for x in segs])
            yield pa.record_batch([b.column(0).cast(key_type), pa.array(scores, pa.float64()), pa.array(found, parts)], ["key", "score", "segments"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, segments array<struct<first_word:bigint,end_word:bigint,score:double,evalue:double>>")
    return out.withColumnRenamed("key", key)


def judged(texts: pa.Array, model: Model) -> Iterator[tuple[float, list]]:
    for _, _, w in blocks(texts):
        for segs, best, total in features(w, model):
            yield _score(model, best, total), segs


def keep_clean(docs: DataFrame, text: str, model: Broadcast, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, in all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([s < threshold for s, _ in judged(b.column(at), model.value)], pa.bool_()))
        free_memory()

    return docs.mapInArrow(run, docs.schema)
