"""Every registered query against its SQL on the smallest tables, and plans without nested loops."""

import math
import os

import duckdb
import pytest

from wellframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["jn02_asof_back", "jn03_asof_fwd", "jn04_bracket_interp", "jn05_nearest_value", "jn06_radius", "jn12_band", "jn14_containment", "jn16_overlap", "jn25_containment", "wn04_trailing"])
def test_no_nested_loops(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["jn16_overlap", "jn17_best_overlap"])
def test_dealt_intervals_are_not_broadcast(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["jn06_radius", "cq03_offsets", "cq03_offsets_depth"])
def test_pairs_of_wells_do_not_move(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "Broadcast" not in above


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.QUERIES["pf02_optional_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(o_orderpriority,2-HIGH)" in plan and "o_orderdate" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
