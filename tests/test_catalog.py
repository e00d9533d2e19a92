"""Every named query against its DuckDB text, and the shape of the plans."""

import pytest
from conftest import SMALL, duck_table, spark_table

import __spark_entry__ as entry_point
from funnelwright.plans.catalog import QUERIES
from funnelwright.plans.oracle import ORACLES


def test_every_query_has_an_oracle():
    """The corpus queries beside them may have none: not all can be said in SQL."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= entry_point.oracle_sql().keys() <= entry_point.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    """Same columns and values as the SQL; no cross join and no Python in the plan."""
    query = QUERIES[name](spark, SMALL)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in plan
    got_columns, got = spark_table(query)
    want_columns, want = duck_table(duck, ORACLES[name])
    assert got_columns == want_columns
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).columns[:2] == ["channel", "sessions"]
