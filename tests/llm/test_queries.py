"""Every registered corpus query on the small tables: against DuckDB where SQL can express it."""

import pytest

from corpus_helpers import SMALL, corpus, table  # noqa: F401

from funnelwright.llm.catalog import QUERIES
from funnelwright.llm.oracle import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, corpus, name):  # noqa: F811
    got, want = QUERIES[name](spark, SMALL), corpus.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def test_native_queries_run_no_python(spark):
    for name in ("op2_sharding", "op3_quality_rules", "op6_secret_scan", "op11_license_scan"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
