"""Mechanisms behind the queries: moments, Bloom filters, brackets, the index of first sessions, buckets of visitors."""

import random
import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from funnelwright.functions.bloom import bloom_filter, might_hold
from funnelwright.functions.frames import exact_percentiles
from funnelwright.functions.linear import cholesky
from funnelwright.functions.special import normal
from funnelwright.operators import bootstrap as bs
from funnelwright.operators import quality as qu
from funnelwright.operators import sessions as se
from funnelwright.operators import visitors as vi
from funnelwright.plans import catalog
from funnelwright.sources.events import hits_from_events, nested_from_events, transaction_sessions_from_events
from funnelwright.sources.tables import read_bucketed_sessions, shared_dir, write_bucketed_sessions

MIDDLE = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- bootstrap from moments --------------------------------------------------

def test_cholesky_of_full_and_singular_matrices(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((6, 6))
    low = rng.standard_normal((6, 2))
    for m in (a @ a.T, low @ low.T, np.zeros((3, 3)), np.diag([4.0, 0.0, 9.0])):
        columns = np.array(spark.createDataFrame([(m.tolist(),)], "m array<array<double>>").select(cholesky(F.col("m"))).first()[0])
        assert np.allclose(columns.T @ columns, m, atol=1e-7 * max(1, np.abs(m).max()))


def test_normal_draws_have_their_moments(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(normal(F.col("id").cast("string"))).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.02 and abs((x > 1.96).mean() - 0.025) < 0.005


def test_moments_are_sums_of_products(spark):
    visitors = {"u": {("a", 0): 2, ("b", 1): 1}, "v": {("a", 0): 3}, "w": {("b", 1): 5, (None, 2): 1, ("", 2): 4}}
    rows = [(v, [((g, d), n) for (g, d), n in cells.items()]) for v, cells in visitors.items()]
    units = spark.createDataFrame(rows, "fullVisitorId string, items array<struct<cell:struct<g:string,depth:int>,n:bigint>>")
    got = bs.cluster_moments(units).first()
    cells = [(c.g, c.depth) for c in got.cells]
    # A missing group and an empty one are two cells.
    assert sorted(cells, key=str) == sorted({c for v in visitors.values() for c in v}, key=str) and len(cells) == 4
    vectors = np.array([[v.get(c, 0) for c in cells] for v in visitors.values()], float)
    assert got.totals == vectors.sum(axis=0).tolist() and np.array_equal(got.products, vectors.T @ vectors)


@pytest.mark.parametrize("pair", [("s04_bootstrap_v", "s04c_bootstrap_v_moments"), ("s06_bootstrap_gap", "s06b_bootstrap_gap_moments")])
def test_moments_agree_with_poisson_draws(spark, pair):
    exact, moments = (sorted(catalog.QUERIES[name](spark, MIDDLE).collect()) for name in pair)
    for x, y in zip(exact, moments, strict=True):
        assert x.estimate == y.estimate and x.replicates == y.replicates == 1000
        assert max(abs(x.low - y.low), abs(x.high - y.high)) < 0.1 * (x.high - x.low)


def test_a_missing_group_is_no_empty_group(spark):
    items = "items array<struct<g:string,depth:int,n:bigint>>"
    units = spark.createDataFrame([([("", 1, 1)],), ([(None, 1, 1)],), ([("a:1", 2, 3)],), ([("a", 1, 2)],), ([("a,1", 1, 1)],)], items)
    assert bs._patterns(units, "items", []).select("pattern").distinct().count() == 5


# ---- transactions ------------------------------------------------------------

def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(0, 4000, 7).select(F.col("id").cast("string").alias("k"))
    bloom = bloom_filter(keys, "k", 256)
    assert len(bloom) == 256
    passed = spark.range(4000).select(F.col("id").cast("string").alias("k")).where(might_hold(bloom, F.col("k")))
    assert keys.join(passed, "k", "left_anti").count() == 0 and passed.count() < 800
    assert bloom_filter(keys.where("k = 'none'"), "k") == [0] * 64


def test_hits_of_chosen_visits_are_filtered_in_the_scan(spark):
    events = catalog.events(spark, SMALL)
    visits = spark.createDataFrame(transaction_sessions_from_events(events).orderBy("tx_id").limit(3).collect())
    chosen = hits_from_events(events, visits=visits)
    want = hits_from_events(events).join(visits.select("fullVisitorId", "visitId"), ["fullVisitorId", "visitId"], "left_semi")
    assert sorted(map(tuple, chosen.collect()), key=repr) == sorted(map(tuple, want.select(chosen.columns).collect()), key=repr)
    # Each scan of the events is filtered before its first exchange: only hits of the chosen visitors are ever numbered.
    plan = plan_of(chosen)
    for branch in re.split(r"FileScan", plan)[:-1]:
        assert "getbit" in branch[branch.rfind("Exchange"):]


def test_transactions_need_one_scan_and_no_join(spark):
    events = catalog.events(spark, SMALL)
    facts = transaction_sessions_from_events(events)
    hits = hits_from_events(events)
    assert sorted(map(tuple, facts.collect()), key=repr) == sorted(
        map(tuple, qu.transaction_sessions(hits).select(facts.columns).collect()), key=repr
    )
    plan = plan_of(qu.tx_duplicates(facts))
    assert plan.count("FileScan") == 1 and "Join" not in plan


# ---- percentiles ---------------------------------------------------------------

@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_are_exact_at_any_accuracy(spark, accuracy):
    rng = random.Random(accuracy)
    for values in ([rng.randint(-50, 10**9) for _ in range(3000)], [5] * 1000 + [7] * 900, [3], [rng.randint(0, 9) for _ in range(2000)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint").repartition(5)
        got = exact_percentiles(df, "v", {f"p{p}": p for p in (1, 50, 95, 100)}, accuracy).first()
        ordered = sorted(values)
        assert [got[f"p{p}"] for p in (1, 50, 95, 100)] == [ordered[-(-len(ordered) * p // 100) - 1] for p in (1, 50, 95, 100)]
    none = exact_percentiles(spark.createDataFrame([(None,)], "v bigint"), "v", {"p50": 50})
    assert none.first().p50 is None


def test_no_window_over_all_values(spark):
    df = spark.range(1000).withColumnRenamed("id", "v")
    plan = plan_of(exact_percentiles(df, "v", {"p50": 50, "p99": 99}))
    assert "Window" in plan and re.search(r"Window \[.*\], \[name#\d+\]", plan) and "SinglePartition" not in plan.split("Window")[1]


# ---- left edge -------------------------------------------------------------------

SESSION = "fullVisitorId string, visitId bigint, date string, visit_number bigint, channel string, source string, purchase_raw int"
SESSIONS = [
    ("a", 1, "2017-01-01", 1, "Social", "mail.google.com", 0),  # left out by the analysis, but the first ever
    ("a", 5, "2017-01-03", 2, "Direct", "(direct)", 1),
    ("b", 2, "2017-01-02", 4, "Social", "x", 1),
    ("c", 3, "2017-01-02", 1, "Direct", "(direct)", 0),
    ("c", 9, "2017-01-04", 2, "Direct", "(direct)", 1),
]


def test_an_excluded_first_session_is_no_history_before_the_window(spark):
    sessions = spark.createDataFrame(SESSIONS, SESSION)
    visitors = vi.visitor_profiles(se.population(sessions))
    index = vi.first_seen(sessions)
    assert tuple(vi.left_truncated(visitors, index).first())[:2] == (3, 1)
    assert sorted(r.fullVisitorId for r in vi.untruncated(visitors, index).collect()) == ["a", "c"]


def test_index_extended_by_day_equals_the_whole(spark):
    sessions = spark.createDataFrame(SESSIONS, SESSION)
    days = [sessions.where(F.col("date") == d) for d in ("2017-01-04", "2017-01-01", "2017-01-03", "2017-01-02")]
    index = vi.first_seen(days[0])
    for day in days[1:]:
        index = vi.extend_first_seen(index, day)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, vi.first_seen(sessions).collect()))


# ---- buckets of visitors -----------------------------------------------------------

def test_sessions_of_a_bucketed_table_need_no_exchange(spark):
    nested = nested_from_events(catalog.events(spark, SMALL), piece_hits=2)
    path = shared_dir(spark, "bucket-test")
    write_bucketed_sessions(nested, "bucket_test", path, 4)
    stored = read_bucketed_sessions(spark, "bucket_test", "2024-01-03", "2024-02-20")
    found = se.behavioural_sessions(se.row_facts(stored, in_place=True))
    assert "Exchange" not in plan_of(found) and "PartitionFilters: [isnotnull(date" in plan_of(found)
    want = se.behavioural_sessions(se.row_facts(nested.where(F.col("date").between("2024-01-03", "2024-02-20"))))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) != []
    spark.sql("DROP TABLE bucket_test")


def test_whole_rows_with_equal_keys_stay_apart_in_place(spark):
    nested = nested_from_events(catalog.events(spark, SMALL)).withColumn("piece", F.lit(None).cast("int"))
    twice = nested.union(nested)
    a, b = (se.row_facts(twice, in_place=x) for x in (False, True))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)
