"""Every registered query against its statement, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from compare import database, difference
from gaugeflow.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()
# Queries that run streams or write files when called: their result plan is a scan of what they wrote.
WRITES = ("x0", "s03", "s09", "s10", "w04_split")


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_statement(spark, con, data, name):
    assert difference(spark, con, QUERIES[name], SQL[name], data) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(WRITES)))
def test_no_cross_join(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "seq"


def test_scans_read_only_what_they_need(spark, data):
    plan = QUERIES["w08_rolling_max"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan
    plan = QUERIES["c02_rules_by_type"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,5)" in plan and "l_tax" not in plan
