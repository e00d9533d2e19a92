"""Tail probabilities, Holm, Poisson draws and the bootstraps."""

import math

import pytest
from pyspark.sql import functions as F

from funnelwright.functions.special import chi_square_tail, poisson, uniform
from funnelwright.operators import bootstrap as bs
from funnelwright.operators import stats as st
from funnelwright.operators import visitors as vi


def exact_tail(x, df):
    """Closed forms for even and odd whole degrees of freedom."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
    odd = sum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2))
    return math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * odd


def test_chi_square_tail(spark):
    cases = [(x, df) for df in (1, 2, 3, 4, 6, 7, 20) for x in (0.0, 0.001, 0.3, 1.0, 2.7, 8.0, 25.0, 120.0, 900.0)]
    rows = spark.createDataFrame(cases, "x double, df int").withColumn("p", chi_square_tail(F.col("x"), F.col("df")))
    for r in rows.collect():
        assert r.p == pytest.approx(exact_tail(r.x, r.df), rel=1e-9, abs=1e-300), (r.x, r.df)
    missing = spark.createDataFrame([(None, 1)], "x double, df int")
    assert missing.select(chi_square_tail(F.col("x"), F.col("df"))).first()[0] is None


@pytest.mark.parametrize("df", [200, 2_000, 20_000, 200_000])
def test_chi_square_tail_of_many_degrees(spark, df):
    """For even df the tail is a Poisson sum."""
    for chi2 in (0.98 * df, float(df), df + 2.0, 1.02 * df):
        x = chi2 / 2
        known = math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(df // 2))
        row = spark.createDataFrame([(chi2, df)], "x double, df int").select(chi_square_tail(F.col("x"), F.col("df"))).first()
        assert row[0] == pytest.approx(known, abs=1e-8)


def test_holm(spark):
    p = [("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, 0.005), ("g", 1, 0.2), ("g", 2, None)]
    got = {(r.family, r.no): r.p_holm for r in st.holm(
        spark.createDataFrame(p, "family string, no int, p double"), "p", ["family"], ["no"]).collect()}
    want = {("f", 4): 0.02, ("f", 1): 0.03, ("f", 3): 0.06, ("f", 2): 0.06, ("g", 1): 0.2, ("g", 2): None}
    assert {k: v and round(v, 12) for k, v in got.items()} == want


@pytest.mark.parametrize("rate", [1, 2, 17, 64, 65, 4000, 3_000_000])
def test_poisson_moments(spark, rate):
    key = F.concat_ws("|", F.lit("x"), F.col("id").cast("string"))
    draws = spark.range(20_000).select(poisson(F.lit(rate), uniform(key)).alias("w"))
    r = draws.agg(F.avg("w"), F.var_pop("w"), F.min("w")).first()
    assert abs(r[0] - rate) < 5 * math.sqrt(rate / 20_000)
    assert abs(r[1] / rate - 1) < 0.06
    assert r[2] >= 0


def test_poisson_unit_draws_have_the_exact_distribution(spark):
    u = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
    for rate in (1, 5, 64, 65):
        got = u.select("u", poisson(F.lit(rate), F.col("u")).alias("w")).collect()
        for r in got:
            below = sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(r.w))
            upto = below + math.exp(-rate) * rate**r.w / math.factorial(r.w)
            assert below <= r.u < upto


@pytest.mark.parametrize("rate", [65, 1000, 100_000])
def test_poisson_draws_invert_the_distribution_function(spark, rate):
    u = spark.createDataFrame([(x,) for x in (1e-9, 0.001, 0.25, 0.5, 0.9, 0.999, 1 - 2.0**-32)], "u double")
    for r in u.select("u", poisson(F.lit(rate), F.col("u")).alias("w")).collect():
        p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(max(0, r.w - 40 * math.isqrt(rate)), r.w + 1)]
        assert math.fsum(p[:-1]) <= r.u + 1e-9 and r.u < math.fsum(p) + 1e-9


@pytest.fixture(scope="module")
def population(spark):
    """1,500 visitors, two sessions each, with entry and purchase rates that differ by channel."""
    r = F.rand(3)
    base = spark.range(3000).select(
        (F.col("id") % 1500).cast("string").alias("fullVisitorId"), F.col("id").alias("visitId"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("channel"),
        F.when(F.col("id") % 2 == 0, "desktop").otherwise("mobile").alias("device"),
        F.xxhash64("id").alias("h"), F.lit("2017-01-01").alias("date"), F.lit(1).cast("bigint").alias("visit_number"),
    )
    u = F.pmod("h", F.lit(1000)) / 1000
    a = F.col("channel") == "A"
    return base.select(
        "*", F.lit(0).alias("view_raw"), F.lit(0).alias("cart_raw"),
        (u < F.when(a, 0.8).otherwise(0.4)).cast("int").alias("checkout_raw"),
        (u < F.when(a, 0.3).otherwise(0.15)).cast("int").alias("purchase_raw"),
    ).drop("h")


def test_patterns_hold_every_session(population):
    patterns = bs.reach_patterns(population, "channel")
    total = patterns.select(F.col("m"), F.aggregate("items", F.lit(0).cast("bigint"), lambda t, i: t + i["n"]).alias("n"))
    r = total.agg(F.sum("m"), F.sum(F.col("m") * F.col("n"))).first()
    assert (r[0], r[1]) == (1500, 3000)
    single = bs.reach_patterns(population, "channel", unit="session")
    assert single.count() <= 2 * 5 and single.agg(F.sum("m")).first()[0] == 3000


def test_bootstrap_v_agrees_between_units(population):
    by_visitor = bs.bootstrap_v_diff(population, "channel", 200).first()
    by_session = bs.bootstrap_v_diff(population, "channel", 200, unit="session").first()
    assert by_visitor.estimate == pytest.approx(by_session.estimate, abs=1e-12)
    for r in (by_visitor, by_session):
        assert r.replicates == 200 and r.low < r.estimate < r.high
    assert by_visitor.high - by_visitor.low == pytest.approx(by_session.high - by_session.low, rel=0.35)
    again = bs.bootstrap_v_diff(population.repartition(7), "channel", 200).first()
    assert (again.low, again.high) == pytest.approx((by_visitor.low, by_visitor.high), abs=1e-9)


def test_bootstrap_gap_matches_the_sample(population):
    r = bs.bootstrap_gap_diff(population, "device", "desktop", "mobile", 100).first()
    p = population.toPandas()
    p["reached"] = p[["checkout_raw", "purchase_raw"]].max(axis=1)
    d, m = p[p.device == "desktop"], p[p.device == "mobile"]
    first = 100 * d.reached.mean() - 100 * m.reached.mean()
    last = 100 * d.purchase_raw.sum() / d.reached.sum() - 100 * m.purchase_raw.sum() / m.reached.sum()
    assert r.estimate == pytest.approx(last - first, abs=1e-9)
    assert r.low < r.estimate < r.high


def test_bootstrap_spearman_keeps_estimate(population):
    visitors = vi.visitor_profiles(population)
    shift = vi.attribution_shift(visitors)
    want = vi.spearman(shift, "last_click", "first_touch").first().rho
    r = bs.bootstrap_spearman(visitors, 50).first()
    assert r.estimate == pytest.approx(want, abs=1e-12) and r.low <= r.estimate <= r.high
