"""Recall of near-duplicates by length and similarity: isolated pairs of random words."""

import random

import pytest

from wellframe.llm import orderminhash

#: words of a text and edits, at similarities of 0.80 to 0.88
CASES = [(8, 1), (12, 2), (16, 3), (20, 3), (25, 5), (30, 5), (38, 7), (45, 8), (60, 11), (100, 20), (200, 36), (500, 80)]
PAIRS = 150


def edited(r, words, edits):
    """The words after so many edits of different words: replaced, or deleted and inserted elsewhere in turn."""
    out = list(words)
    for place in r.sample(range(len(words)), edits):
        out[place] = f"n{r.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def classes(spark):
    r = random.Random(20)
    rows = []
    for c, (n, edits) in enumerate(CASES):
        for p in range(PAIRS):
            words = [f"w{r.randrange(10**9)}" for _ in range(n)]
            rows += [(c * 1000 + 2 * p, " ".join(words)), (c * 1000 + 2 * p + 1, " ".join(edited(r, words, edits)))]
    df = spark.createDataFrame(rows, "id long, text string")
    return {x.id: x.class_id for x in orderminhash.near_duplicates(df, "id", "text").collect()}


@pytest.mark.parametrize("c", range(len(CASES)), ids=[f"{n}-{e}" for n, e in CASES])
def test_recall(classes, c):
    found = sum(classes[c * 1000 + 2 * p] == classes[c * 1000 + 2 * p + 1] for p in range(PAIRS))
    assert found >= 0.9 * PAIRS, found / PAIRS


def test_no_class_joins_different_pairs(classes):
    assert all(v // 2 == k // 2 for k, v in classes.items())
