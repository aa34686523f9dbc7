"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, same, spark_rows, sql_rows
from lagwise.plans import oracle
from lagwise.plans.queries import QUERIES

ORACLE = oracle.build()


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, database, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert not [word for word in UNWANTED if word in plan]
    names, rows = spark_rows(df)
    sql_names, expected = sql_rows(database, ORACLE[name])
    assert names == sql_names
    assert len(rows) == len(expected)
    differing = [(a, b) for a, b in zip(rows, expected) if not same(a, b)]
    assert differing == []


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    result = entry_point.entry(spark)
    assert result.count() > 0
    assert "teacher_acctid_y_prev" in result.columns
