"""Steps that take long for their bytes get all tasks, however small their tables are, and give the rows that they gave."""

import pandas as pd
from pyspark.sql import functions as F
from wellframe.streaming import detectors


def test_detectors_read_wellbores_as_one_stream(spark):
    n = F.col("id")
    series = spark.range(700).select((n % 7).cast("string").alias("wellbore_id"), (1000 + n / 14).alias("md_m"), F.when(n % 5 > 0, n * 30.0).alias("t"), F.lit(12.0).alias("rop_m_h"), F.lit(2000.0).alias("flow_in_lpm"), (2000.0 - F.when(n % 90 > 40, 300).otherwise(0)).alias("flow_out_lpm"), F.when(n % 11 > 0, 40 + n % 3 / 2).alias("pit_vol_m3"), (15 + n % 97 / 97).alias("torque_knm"))
    out = detectors.detect_batch(series)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = []
    for key, rows in series.toPandas().groupby("wellbore_id"):
        want += detectors._rows(key, detectors.Bank(), rows)
    plain = lambda rows: sorted(str(tuple(None if pd.isna(x) else x for x in r)) for r in rows)
    assert plain(out.collect()) == plain(want)


def _tasks(df) -> list[int]:
    """Partitions asked for by number in the plan."""
    import re

    return [int(n) for n in re.findall(r"RepartitionByExpression \[[^\n]*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]


def test_answers_and_items_get_all_tasks(spark, sf):
    from wellframe.plans.registry import QUERIES

    assert len(_tasks(QUERIES["fn35_checked_answers"](spark, sf))) >= 2
    assert len(_tasks(QUERIES["cq18_validated_items"](spark, sf))) >= 3


def test_overlap_gets_more_tasks_as_tables_grow(spark, sf, monkeypatch):
    from wellframe.operators import stages
    from wellframe.plans.registry import QUERIES

    before = sorted(tuple(r) for r in QUERIES["jn17_best_overlap"](spark, sf).collect())
    monkeypatch.setattr(stages, "TASK_ROWS", 100)
    df = QUERIES["jn17_best_overlap"](spark, sf)
    assert len(_tasks(df)) == 3 and min(_tasks(df)) > 10
    assert sorted(tuple(r) for r in df.collect()) == before


def test_texts_searched_side_by_side_and_in_all_tasks(spark, sf, monkeypatch):
    import random

    from wellframe.functions import fuzzy
    from wellframe.plans.registry import QUERIES

    r, a, b = random.Random(5), [], []
    for _ in range(400):
        letters = "abcde 𝄞é"[: r.choice([2, 5, 8])]
        n, m = r.randint(0, 700), r.choice([0, 1, 40, 63, 64, 65, 80, 128, 129, 256, 257])
        text, at = "".join(r.choices(letters, k=n)), r.randint(0, 500)
        near = "".join(c if r.random() < 0.85 else r.choice(letters) for c in text[at : at + m])
        a.append(r.choice([None, near, near, "".join(r.choices(letters, k=m))]))
        b.append(text)
    for least, many in ((0.0, 1 << 20), (80.0, 3000)):
        monkeypatch.setattr(fuzzy, "MANY", many)
        assert fuzzy.partial_ratios(a, b, least) == [0.0 if x is None else fuzzy.partial_ratio(x, y, least) for x, y in zip(a, b)]
    assert len(_tasks(QUERIES["jn25_fuzzy_snippets"](spark, sf))) == 2
    assert len(_tasks(QUERIES["cq16_chunk_index"](spark, sf))) >= 3
