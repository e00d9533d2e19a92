"""One visitor, one visit or one channel holding a third of all events."""

import duckdb
import pytest
from conftest import duck_table, spark_table
from pyspark.sql import functions as F

from funnelwright.plans.catalog import QUERIES
from funnelwright.plans.oracle import ORACLES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """6,000 events of which visitor 7 makes 2,000: one long visit, then single visits, with equal timestamps."""
    path = tmp_path_factory.mktemp("skew")
    hot = F.col("id") % 3 == 0
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "signup", "purchase", "error")])
    second = F.when(hot & (F.col("id") < 4500), F.floor(F.col("id") / 2) * 5).otherwise(F.col("id") * 400)
    (
        spark.range(6000)
        .select(
            F.col("id").alias("event_id"),
            (F.timestamp_seconds(F.lit(1704067200) + second)).cast("timestamp_ntz").alias("ts"),
            F.when(hot, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(97)) + 1).cast("bigint").alias("user_id"),
            F.get(kinds, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("int")).alias("event_type"),
            (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)) / 100).alias("value"),
            F.lit("{}").alias("props"),
        )
        .coalesce(1)
        .write.parquet(str(path / "events.parquet"))
    )
    return str(path)


@pytest.mark.parametrize(
    "name",
    ["b01_step_flags", "b03_behavioural_sessions", "q04_tx_duplicates", "q10_tx_revenue_hits", "q12_funnel_by_channel",
     "q16b_hidden_direct_landing", "q17b_hidden_direct_concentration", "s04_bootstrap_v", "s10_attribution_shift",
     "s13b_visits_to_purchase", "s14_right_edge"],
)
def test_hot_visitor(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert spark_table(QUERIES[name](spark, folder)) == duck_table(con, ORACLES[name])


def test_hot_visitor_is_reduced_before_the_shuffle(spark, folder):
    """Between the scan and the first exchange there is a partial aggregate, never a window."""
    plan = QUERIES["b03_behavioural_sessions"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    first = plan[: plan.rindex("FileScan")]
    last_exchange = first.rindex("Exchange hashpartitioning")
    assert "partial_count" in first[last_exchange:] or "partial_max" in first[last_exchange:]
    assert "Window" not in first[last_exchange:]
