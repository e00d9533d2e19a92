"""Derived figures on the published tables, against the figures stated with them."""

import pytest
from goldens import (
    BY_CHANNEL, BY_DEVICE, BY_VARIANT, BY_VISITOR, CONFOUND, COUNTRIES, CROSS, FUNNEL, INTERNAL, REV_HITS,
)
from pyspark.sql import functions as F

from funnelwright.operators import metrics as me
from funnelwright.operators import quality as qu
from funnelwright.operators import segments as sg
from funnelwright.operators import stats as st

STEPS = ["viewed", "cart", "checkout", "purchase"]


@pytest.fixture(scope="module")
def channel(spark):
    return spark.createDataFrame(BY_CHANNEL, ["channel", *FUNNEL])


@pytest.fixture(scope="module")
def device(spark):
    return spark.createDataFrame(BY_DEVICE, ["device", *FUNNEL])


@pytest.fixture(scope="module")
def variants(spark):
    return spark.createDataFrame(BY_VARIANT, ["variant", "device", *FUNNEL])


@pytest.fixture(scope="module")
def cross(spark):
    return spark.createDataFrame(
        CROSS, ["channel", "device", "sessions", "viewed_strict", "purchase_mono", "cr_pct"]
    )


def by_step(rows, value, **where):
    found = {r["step"]: r[value] for r in rows if all(r[k] == v for k, v in where.items())}
    return [found[s] for s in STEPS]


def test_device_gap_and_ratio(device):
    rows = me.gap(me.step_lines(device, "device"), "device", "desktop", "mobile").collect()
    assert [round(x, 2) for x in by_step(rows, "gap_pp", version="mono")] == [2.25, 10.14, 15.06, 22.67]
    assert [round(x, 2) for x in by_step(rows, "gap_pp", version="strict")] == [2.04, 10.27, 15.31, 21.92]
    assert [round(x, 2) for x in by_step(rows, "ratio", version="mono")] == [1.17, 1.31, 1.50, 1.71]
    ends = me.gap_extremes(me.gap(me.step_lines(device, "device"), "device", "desktop", "mobile")).collect()
    assert {(r.largest_step, r.smallest_step) for r in ends} == {("purchase", "viewed")}


def test_returning_gap(spark):
    funnel = spark.createDataFrame(BY_VISITOR, ["visitor_type", *FUNNEL[:5]])
    long = me.step_lines(funnel, "visitor_type", ["mono"])
    rows = me.gap(long, "visitor_type", "returning", "new").collect()
    assert [round(x, 2) for x in by_step(rows, "gap_pp")] == [10.87, 15.06, 17.80, 17.48]


def test_spread(channel):
    rows = [r for r in me.spread(me.step_lines(channel, "channel"), "channel").collect() if r.version == "mono"]
    assert [round(x, 1) for x in by_step(rows, "spread_pp")] == [30.4, 18.5, 41.4, 58.5]
    assert [round(x, 1) for x in by_step(rows, "overall_spread_pp")] == [30.4, 15.9, 9.5, 6.3]
    assert [round(x) for x in by_step(rows, "overall_max_over_min")] == [14, 23, 63, 232]


def test_entry_loss_and_waterfall(channel):
    loss = {r["sample"]: r for r in me.entry_loss_excluding(channel, "channel", "Social").collect()}
    assert (loss["all"].sessions, round(loss["all"].pct_lost, 1)) == (879171, 85.2)
    assert (loss["without"].sessions, round(loss["without"].pct_lost, 1)) == (654749, 80.9)
    rows = me.loss_waterfall(me.step_lines(channel, "channel"), "channel").where("version = 'mono'").collect()
    lost = by_step(rows, "lost")
    assert lost[0] == 879171 - 130006 and sum(lost) == 879171 - 11398


def test_versions(channel):
    long = me.step_lines(channel, "channel")
    assert me.check_monotone(long, "channel").first().violations == 0
    row = me.version_gap(long, "channel").where("channel = 'ALL' AND step = 'purchase'").first()
    assert (row.mono, row.strict, row.difference) == (11398, 9078, 2320)
    assert round(row.strict_pct_of_mono, 1) == 79.6
    matrix = {r.channel: r for r in me.rate_matrix(long, "channel", "cr_overall").where("version = 'mono'").collect()}
    assert round(matrix["ALL"].purchase, 3) == 1.296


def test_confound_range(spark):
    df = spark.createDataFrame(CONFOUND, ["channel", "purchase_sessions", "pct_buyers_no_view"])
    row = me.confound_range(df, "channel").first()
    assert (row.min_group, row.min_pct, row.max_group, row.max_pct) == ("Referral", 15.79, "Direct", 28.98)


def test_backfill(device):
    rows = {r.device: r for r in me.backfill(device, "device").collect()}
    assert (rows["desktop"].added, rows["mobile"].added) == (6254, 1598)
    assert round(rows["desktop"].lift_pp, 2) == 0.98


def test_thin_steps(spark):
    df = spark.createDataFrame(COUNTRIES, ["country", *FUNNEL[:5]])
    assert {r.country for r in sg.thin_steps(df).collect()} == {"India", "United Kingdom", "Vietnam"}


def test_cross(cross):
    counts = sg.cross_cell_counts(cross).first()
    assert (counts.cells, counts.below, counts["pass"]) == (21, 13, 8)
    first = sg.ranked_cells(cross).first()
    assert (first.channel, first.device, first.cr_pct) == ("Referral", "desktop", 6.687)
    masked = {r.channel: r for r in sg.masked_cross(cross, ["desktop", "mobile", "tablet"]).collect()}
    assert masked["Referral"].mobile is None and masked["Direct"].mobile == 0.45
    assert cross.agg(F.sum("sessions")).first()[0] == 879171
    rows = {r.variant: r for r in sg.cross_variants(cross).collect()}
    assert round(rows["all"].entry_gap_pp, 2) == 2.04
    assert rows["no_referral"].sessions_desktop == 640959 - 77743


def last_minus_first(r):
    """As published: the difference of the two rounded gaps."""
    return round(round(r.purchase, 2) - round(r.viewed, 2), 2)


def test_variants(variants):
    removed = {r.variant: r for r in sg.variant_removed(variants).collect()}
    assert removed["no_hidden_referral"].removed == 68860
    assert removed["no_hidden_referral"].removed_device == 68395
    assert round(removed["no_hidden_referral"].pct_device, 1) == 99.3
    mono = {r.variant: r for r in sg.variant_gaps(variants).collect() if r.version == "mono"}
    stated = {
        "all": (2.25, 10.14, 15.06, 22.67, 20.42), "no_social": (7.60, 10.33, 14.43, 22.83, 15.23),
        "no_hidden_referral": (-0.31, 6.92, 8.57, 15.01, 15.32), "no_both": (4.81, 7.07, 7.92, 15.36, 10.55),
    }
    for variant, figures in stated.items():
        r = mono[variant]
        assert tuple(round(x, 2) for x in (r.viewed, r.cart, r.checkout, r.purchase)) == figures[:4]
        assert last_minus_first(r) == figures[4]
        assert abs(r.last_minus_first - (r.purchase - r.viewed)) < 1e-12
    strict = {r.variant: last_minus_first(r) for r in sg.variant_gaps(variants).collect() if r.version == "strict"}
    assert strict == {"all": 19.88, "no_social": 15.13, "no_hidden_referral": 14.22, "no_both": 9.89}


def test_checks(spark, device):
    rec = spark.createDataFrame(
        [(902755, 120, 23464, 0, 879171)],
        ["sessions_all", "excl_no_channel", "excl_internal_google", "excl_overlap", "sessions_kept"],
    )
    assert me.check_exclusions(rec).first().holds
    assert me.check_total(device, "device", rec).first().agree


def test_revenue_figures(spark):
    truth = spark.createDataFrame([(1540071.24, 1782822.23)], ["session_level_usd", "hit_level_usd"])
    gap = qu.revenue_gap(truth).first()
    assert (round(gap.gap_usd, 2), round(gap.gap_pct, 1)) == (242750.99, 15.8)
    hits = spark.createDataFrame(REV_HITS, ["rev_hits", "tx_count"])
    row = qu.reissue_summary(hits, truth).first()
    assert (row.transactions, row.no_revenue_hit, row.one_revenue_hit, row.several_revenue_hits) == (11552, 37, 11165, 350)
    assert row.with_revenue == 11515


def test_internal_split(spark):
    df = spark.createDataFrame(INTERNAL, ["source", "medium", "sessions", "purchase_sessions"])
    rows = {r.part: r for r in qu.internal_split(df).collect()}
    assert (rows["listed"].sessions, round(rows["listed"].cr_pct, 2)) == (6377, 2.32)
    assert rows["all"].biggest_source == "analytics.google.com"


def test_missing_steps(spark):
    df = spark.createDataFrame(
        [(11551, 2163, 1421, 7)],
        ["purchase_sessions", "purchase_without_view", "purchase_without_cart", "purchase_without_checkout"],
    )
    rows = {r.missing_step: r for r in qu.missing_steps(df).collect()}
    assert round(rows["view"].pct_of_purchases, 2) == 18.73 and rows["checkout"].purchases == 7


def test_chi_square_on_published_funnel(channel):
    rows = st.chi_square(me.step_lines(channel, "channel"), "channel").collect()
    assert [round(x, 2) for x in by_step(rows, "chi2", version="mono")] == [52306.64, 2028.91, 2483.31, 1221.05]
    assert [round(x, 4) for x in by_step(rows, "cramers_v", version="mono")] == [0.2439, 0.1249, 0.2179, 0.2354]
    assert [round(x, 4) for x in by_step(rows, "cramers_v", version="strict")] == [0.2363, 0.1228, 0.2146, 0.2369]
    assert all(r.groups == 7 and r.significant for r in rows)


def test_z_test_on_published_variants(variants):
    long = me.step_lines(variants, "device", by=["variant"])
    rows = st.z_test(long, "device", "desktop", "mobile", by=["variant"]).collect()
    assert [round(x, 2) for x in by_step(rows, "z", version="mono", variant="all")] == [25.05, 30.24, 26.09, 21.95]
    hidden = by_step(rows, "z", version="mono", variant="no_hidden_referral")
    assert [round(x, 2) for x in hidden] == [-3.60, 20.17, 14.66, 14.02]


def test_variation_of_conversion(channel):
    rate = channel.where("channel <> 'ALL'").select((F.col("purchase_mono") / F.col("sessions")).alias("r"))
    assert round(rate.agg(F.stddev_pop("r") / F.avg("r")).first()[0], 4) == 1.0796
