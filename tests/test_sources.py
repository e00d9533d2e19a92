"""Readers, writers, adapter."""

import pytest
from goldens import BY_CHANNEL, FUNNEL
from pyspark.sql import functions as F

from funnelwright.operators import funnel as fu
from funnelwright.operators import quality as qu
from funnelwright.operators import sessions as se
from funnelwright.plans import catalog
from funnelwright.sources import tables
from funnelwright.sources.events import hits_from_events, nested_from_events, rows_from_events
from funnelwright.sources.schemas import RAW_SESSION, RESULTS
from conftest import SMALL


def test_date_range_is_inclusive_and_prunes(spark, tmp_path):
    nested = catalog.nested(spark, SMALL).drop("piece")
    path = str(tmp_path / "sessions")
    tables.write_sessions(nested, path)
    days = [r.date for r in nested.select("date").distinct().orderBy("date").collect()]
    got = tables.read_sessions(spark, path, days[2], days[5])
    assert [r.date for r in got.select("date").distinct().orderBy("date").collect()] == days[2:6]
    assert got.count() == nested.where(F.col("date").between(days[2], days[5])).count()
    plan = se.with_step_flags(got).select("view_raw")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "ReadSchema: struct<hits:array<struct<eCommerceAction:struct<action_type:string>>>>" in plan


def leaves_read(df):
    """The schema each scan reads."""
    scans = []

    def walk(plan):
        if plan.nodeName().startswith("Scan"):
            scans.append(plan.requiredSchema().simpleString())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.inputPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return scans


def test_queries_read_only_their_leaves(spark, tmp_path):
    path = str(tmp_path / "sessions")
    tables.write_sessions(catalog.nested(spark, SMALL).drop("piece"), path)
    # A table of whole rows; one with pieces is read a second time for them.
    stored = tables.read_sessions(spark, path, "2024-01-01", "2024-12-31", RAW_SESSION.removesuffix(", piece int"))
    P = se.population(se.behavioural_sessions(se.row_facts(stored)))
    keys, origin = "fullVisitorId:string,visitId:bigint", "channelGrouping:string,trafficSource:struct<source:string>"
    action = "eCommerceAction:struct<action_type:string>"
    tx = "transaction:struct<transactionId:string,transactionRevenue:bigint>"
    assert leaves_read(fu.funnel_by(P, "channel")) == [f"struct<{keys},{origin},hits:array<struct<{action}>>>"]
    assert leaves_read(fu.monotone_confound(P, "channel")) == [
        f"struct<{keys},{origin},hits:array<struct<hitNumber:bigint,{action}>>>"
    ]
    assert leaves_read(qu.tx_duplicate_examples(se.transaction_hits(stored))) == [
        f"struct<{keys},hits:array<struct<{tx}>>>"
    ]
    assert leaves_read(se.session_steps_exploded(se.hit_facts(stored, ["action_type"]))) == [
        f"struct<{keys},hits:array<struct<{action}>>>"
    ]
    assert leaves_read(qu.unknown_channels(se.row_facts(stored))) == [
        "struct<channelGrouping:string,trafficSource:struct<source:string,medium:string>>"
    ]
    full = se.hit_facts(stored).where("tx_id IS NOT NULL")
    picked = se.transaction_hits(stored, list(se.HIT_LEAVES))
    assert picked.exceptAll(full).isEmpty() and full.exceptAll(picked).isEmpty()


def test_result_round_trip(spark, tmp_path):
    df = spark.createDataFrame(BY_CHANNEL + [(None, *range(9))], ["channel", *FUNNEL])
    path = str(tmp_path / "r")
    tables.write_result(df, path)
    back = tables.read_result(spark, path, RESULTS["12_funnel_by_channel"])
    assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_write_rounds_only_named_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, 1.23456)], "k string, x double, y double")
    path = str(tmp_path / "r")
    tables.write_result(df, path, {"x": 2})
    assert tuple(tables.read_result(spark, path, "k string, x double, y double").first()) == ("a", 1.23, 1.23456)


def test_optional(spark, tmp_path):
    assert tables.read_optional(spark, str(tmp_path / "none"), "a bigint") is None
    path = str(tmp_path / "r")
    tables.write_result(spark.createDataFrame([(1, "x", 2.5)], "a bigint, extra string, b double"), path)
    assert tables.read_optional(spark, path, "a bigint, c bigint") is None
    found = tables.read_optional(spark, path, "b double, a bigint")
    assert dict(found.dtypes) == {"a": "bigint", "extra": "string", "b": "double"}
    assert tuple(found.first()) == (1, "x", 2.5)


def test_nested_and_flat_paths_agree(spark):
    events = catalog.events(spark, SMALL)
    flat = rows_from_events(events)
    for piece in (2, 500):
        nested = se.row_facts(nested_from_events(events, piece)).select(flat.columns)
        assert nested.exceptAll(flat).isEmpty() and flat.exceptAll(nested).isEmpty()
    longest = nested_from_events(events, 2).agg(F.max(F.size("hits"))).first()[0]
    assert longest == 2
    hits = hits_from_events(events)
    exploded = se.hit_facts(nested_from_events(events, 3)).select(hits.columns)
    assert exploded.exceptAll(hits).isEmpty() and hits.exceptAll(exploded).isEmpty()


def test_cell_width_does_not_change_the_result(spark):
    events = catalog.events(spark, SMALL)
    base = rows_from_events(events)
    for seconds in (60, 43_200):
        other = rows_from_events(events, seconds)
        assert other.exceptAll(base).isEmpty() and base.exceptAll(other).isEmpty()
    hits = hits_from_events(events)
    other = hits_from_events(events, 7_200)
    assert other.exceptAll(hits).isEmpty() and hits.exceptAll(other).isEmpty()


class _Context:
    applicationId = "app"

    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, setting, master="local[2]"):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": setting}, _Context(master)


def test_shared_folder_comes_from_the_session():
    for master in ("local[2]", "spark://host:7077"):
        named = _Session("hdfs://shared/dir", master)
        assert tables.shared_dir(named, "x").startswith("hdfs://shared/dir/funnelwright/app/x-")
    unset = _Session(None)
    assert tables.shared_dir(unset, "x") != tables.shared_dir(unset, "x")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(_Session(None, master), "x")


def _same(a, b):
    b = b.select(a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture
def long_visit(spark):
    """One visit of 900 hits over midnight, with purchases, and a short visit of another visitor."""
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "signup", "purchase")])
    second = F.lit(1704150000) + F.col("id") * 10  # from 23:00 on
    return spark.range(903).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(second).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") < 900, 7).otherwise(8).cast("bigint").alias("user_id"),
        F.get(kinds, F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")).alias("event_type"),
        F.lit(1.17).alias("value"),
        F.lit("{}").alias("props"),
    )


def test_a_long_visit_survives_the_stored_table(spark, tmp_path, long_visit):
    path = str(tmp_path / "sessions")
    tables.write_sessions(nested_from_events(long_visit), path)
    stored = tables.read_sessions(spark, path, "2024-01-01", "2024-01-31")
    assert stored.count() > se.row_facts(stored).count() == 3
    _same(se.row_facts(stored), rows_from_events(long_visit))
    _same(se.hit_facts(stored), hits_from_events(long_visit))


def test_whole_rows_with_equal_keys_stay_apart(spark, tmp_path, long_visit):
    nested = nested_from_events(long_visit, 10_000).drop("piece")
    path = str(tmp_path / "sessions")
    tables.write_sessions(nested.union(nested), path)
    assert se.row_facts(tables.read_sessions(spark, path, "2024-01-01", "2024-01-31")).count() == 6


def test_events_without_visitor_or_time_belong_to_no_visit(spark):
    events = catalog.events(spark, SMALL)
    holed = events.withColumns({
        "user_id": F.when(F.col("event_id") % 10 != 0, F.col("user_id")),
        "ts": F.when(F.col("event_id") % 7 != 0, F.col("ts")),
    })
    whole = events.where("event_id % 10 != 0 AND event_id % 7 != 0")
    _same(rows_from_events(holed), rows_from_events(whole))
    _same(hits_from_events(holed), hits_from_events(whole))
    assert rows_from_events(holed).agg(F.sum("n_hits")).first()[0] == hits_from_events(holed).count() == whole.count()
