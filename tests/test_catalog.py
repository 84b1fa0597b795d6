"""Every query with a DuckDB twin gives the same rows at the smallest scale."""

import duckdb
import pytest

from keyloft.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"stream_replay"}))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    columns = sorted(df.columns)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    assert plain(df.select(*columns).collect()) == plain(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_pushdown_and_shuffles(spark):
    plan = catalog.get_point(spark, D)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(c_custkey" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    replay = catalog.replay_replies(spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in replay and "BroadcastNestedLoopJoin" not in replay


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
