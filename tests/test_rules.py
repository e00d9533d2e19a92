"""Hand-made sessions for each analysis rule and trap."""

import pytest
from pyspark.sql import functions as F

from funnelwright.functions.rules import is_internal
from funnelwright.operators import attribution as at
from funnelwright.operators import funnel as fu
from funnelwright.operators import metrics as me
from funnelwright.operators import quality as qu
from funnelwright.operators import sessions as se
from funnelwright.operators import stats as st
from funnelwright.operators import visitors as vi
from funnelwright.sources.schemas import RAW_SESSION


def hit(number, action=None, kind="PAGE", path="/home", tx=None, revenue=None):
    return (number, kind, (path,), (action,), (tx, revenue))


def row(visitor, visit, date, hits, channel="Direct", source="google", medium="organic", number=1, new=None,
        revenue=None, device="desktop", path=None, network="n", true_direct=None, country="c"):
    n = None if hits is None else len(hits)
    return (
        visitor, visit, date, number, channel, (source, medium, true_direct, path), (device,), (country, network),
        (n, n, None, revenue, new), hits, None,
    )


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, RAW_SESSION)


def sessions_of(df):
    return se.behavioural_sessions(se.row_facts(df))


def test_midnight_halves_are_one_session(make):
    df = make([row("a", 1, "20170102", [hit(2, "6")]), row("a", 1, "20170101", [hit(1, "2")])])
    s = sessions_of(df).collect()
    assert len(s) == 1
    assert (s[0].view_raw, s[0].cart_raw, s[0].purchase_raw, s[0].n_hits, s[0].date) == (1, 0, 1, 2, "20170101")


def test_attributes_come_from_the_earliest_row(make):
    late = row("a", 1, "20170102", [hit(2)], channel="Social", source="x.com", medium="m2", device="mobile")
    early = row("a", 1, "20170101", [hit(1)], channel=None, source=None, medium="m1", device="tablet")
    for rows in ([late, early], [early, late]):
        s = sessions_of(make(rows)).first()
        assert (s.channel, s.source, s.medium, s.device) == (None, "", "m1", "tablet")


def test_flags_of_odd_hit_arrays(make):
    df = make([
        row("a", 1, "d", None), row("b", 1, "d", []), row("c", 1, "d", [hit(1, None)]),
        row("d", 1, "d", [hit(1, None), hit(2, "2")]), row("e", 1, "d", [hit(1, "0", kind="EVENT", path=None)]),
    ])
    flags = {r.fullVisitorId: (r.view_raw, r.n_hits, r.landing_page) for r in se.row_facts(df).collect()}
    assert flags == {"a": (0, None, None), "b": (0, 0, None), "c": (0, 1, "/home"), "d": (1, 2, "/home"),
                     "e": (0, 1, None)}
    exploded = {r.fullVisitorId for r in se.session_steps_exploded(se.hit_facts(df)).collect()}
    assert exploded == {"c", "d", "e"}
    assert {r.fullVisitorId for r in qu.session_steps(se.row_facts(df)).collect()} == exploded


def test_landing_page_goes_by_hit_number(make):
    df = make([row("a", 1, "d", [hit(9, path="/late"), hit(3, path="/first"), hit(1, kind="EVENT", path="/event")])])
    assert se.with_landing_page(df).first().landing_page == "/first"
    assert se.row_facts(df).first().landing_page == "/first"


def test_pieces_of_a_row_are_merged(make):
    whole = make([row("a", 1, "d", [hit(1, kind="EVENT"), hit(2, "2"), hit(3, "6", path="/p", tx="T", revenue=5)])])
    parts = make([
        row("a", 1, "d", [hit(3, "6", path="/p", tx="T", revenue=5)]), row("a", 1, "d", [hit(1, kind="EVENT"), hit(2, "2")]),
    ]).withColumn("piece", F.when(F.size("hits") == 1, 1).otherwise(0))
    cols = ["n_hits", "view_raw", "purchase_raw", "hit_revenue", "landing_page"]
    assert se.row_facts(parts).select(cols).collect() == se.row_facts(whole).select(cols).collect()


def test_population_keeps_bare_domain_and_null_source(make):
    sources = ["google.com", "mail.google.com", "notgoogle.com", None, "a.b.google.com"]
    df = make([row(str(i), 1, "d", [], source=s) for i, s in enumerate(sources)])
    kept = {r.source for r in se.population(sessions_of(df)).collect()}
    assert kept == {"google.com", "notgoogle.com", ""}
    assert df.select(is_internal("trafficSource.source")).where("endswith(trafficSource.source, '.google.com')").count() == 2


def test_exclusions_overlap(make):
    df = make([
        row("a", 1, "d", []), row("b", 1, "d", [], channel=None), row("c", 1, "d", [], channel="(Other)"),
        row("e", 1, "d", [], source="mail.google.com"), row("f", 1, "d", [], channel=None, source="x.google.com"),
    ])
    rec = fu.exclusions_reconciliation(sessions_of(df))
    assert tuple(rec.first()) == (5, 3, 2, 1, 1)
    assert me.check_exclusions(rec).first().holds


def test_monotone_and_strict(make):
    df = make([
        row("a", 1, "d", [hit(1, "6")]), row("b", 1, "d", [hit(1, "2"), hit(2, "3")]),
        row("c", 1, "d", [hit(1, "2"), hit(2, "3"), hit(3, "5"), hit(4, "6")]),
    ])
    total = fu.funnel_by(sessions_of(df), "channel").where("channel = 'ALL'").first()
    assert (total.viewed_mono, total.cart_mono, total.checkout_mono, total.purchase_mono) == (3, 3, 2, 2)
    assert (total.viewed_strict, total.cart_strict, total.checkout_strict, total.purchase_strict) == (2, 2, 1, 1)


def test_null_group_is_not_the_total(make):
    df = make([row("a", 1, "d", [], device=None), row("b", 1, "d", [], device="mobile")])
    counts = {r.device: r.sessions for r in fu.funnel_by(sessions_of(df), "device").collect()}
    assert counts == {"ALL": 2, None: 1, "mobile": 1}


def test_null_country_takes_a_place_but_is_not_shown(make):
    rows = [row(f"n{i}", 1, "d", [], country=None) for i in range(3)]
    rows += [row(f"u{i}", 1, "d", [], country="US") for i in range(2)] + [row("v", 1, "d", [], country="VN")]
    top = fu.funnel_top_groups(sessions_of(make(rows)), "country", 2).collect()
    assert [r.country for r in top] == ["US"]


def test_zero_denominators_are_null(make):
    df = make([row("a", 1, "d", [hit(1)], source="(direct)", medium="(none)")])
    s = sessions_of(df)
    got = at.direct_source_vs_channel(s).first()
    assert got.pct_return_rest is None and got.pct_return_direct == 0.0
    assert fu.monotone_confound(s, "channel").first().pct_buyers_no_view is None
    assert st.cv_compare(s).first().cv_order_value is None


def test_minimum_cell_is_inclusive(spark):
    df = spark.createDataFrame([("a", 99, 1.0), ("b", 100, 2.0)], "k string, n bigint, v double")
    assert [r.k for r in se.min_cell(df, "n").collect()] == ["b"]
    assert {r.k: r.v for r in se.min_cell(df, "n", mask=["v"]).collect()} == {"a": None, "b": 2.0}


def test_variants_have_one_line_per_kept_sample(make):
    df = make([
        row("a", 1, "d", [], channel="Social"), row("b", 1, "d", [], channel="Referral", source="(direct)", medium="(none)"),
        row("c", 1, "d", [], channel="Display"),
    ])
    from funnelwright.operators.segments import sample_variants

    counts = se.with_variants(sessions_of(df), sample_variants()).groupBy("variant").count().collect()
    assert {r.variant: r["count"] for r in counts} == {"all": 3, "no_social": 2, "no_hidden_referral": 2, "no_both": 1}


def test_transactions_reissued(make):
    df = make([
        row("a", 1, "d", [hit(1, "6", tx="T1", revenue=10_000_000), hit(2, "6", tx="T1"), hit(3, "6", tx="T1", revenue=30_000_000)]),
        row("b", 1, "d", [hit(1, "6", tx="T2")]), row("c", 1, "d", [hit(1, "6", tx="T3", revenue=1_000_000)]),
        row("d", 1, "d", [hit(1, "6", tx="T3", revenue=1_000_000)]),
    ])
    hits = se.hit_facts(df)
    assert tuple(qu.tx_duplicates(hits).first()) == (3, 2, 1)
    assert [tuple(r) for r in qu.tx_duplicate_examples(hits).collect()] == [("T1", 3, 1, 40.0), ("T3", 2, 2, 2.0)]
    assert {tuple(r) for r in qu.rev_hits_distribution(hits).collect()} == {(0, 1), (2, 2)}
    assert [(r.hitNumber, r.rev) for r in qu.tx_hits(hits, ["T1"]).collect()] == [(1, 10.0), (2, None), (3, 30.0)]


def test_revenue_levels(make):
    df = make([
        row("a", 1, "d", [hit(1, "6", tx="T", revenue=2_000_000), hit(2, "6", tx="T", revenue=3_000_000)], revenue=2_000_000),
        row("b", 1, "d", [hit(1)]), row("c", 1, "d", None),
    ])
    rows = se.row_facts(df)
    assert tuple(qu.revenue_source_of_truth(rows).first()) == (2.0, 5.0)
    assert tuple(qu.revenue_distribution(rows).first()) == (3, 2, 0, 0, 2.0, 2.0, 2.0, 2.0, 2.0)
    s = st.revenue_by(se.behavioural_sessions(rows), "channel").first()
    assert (s.sessions, s.avg_order_usd) == (3, 2.0) and round(s.revenue_per_session_usd, 6) == 0.666667


def test_revenue_all_null(make):
    rows = se.row_facts(make([row("a", 1, "d", [hit(1)])]))
    got = qu.revenue_distribution(rows).first()
    assert (got.sessions, got.revenue_null, got.min_usd, got.p50_usd) == (1, 1, None, None)


def test_exact_percentiles_against_sorting(spark):
    from funnelwright.functions.frames import exact_percentiles

    values = [(int(i * i % 9973) * 10_000,) for i in range(1, 2500)] + [(50_000,)] * 1000 + [(None,)] * 7
    df = spark.createDataFrame(values, "v bigint")
    ordered = sorted(v for (v,) in values if v is not None)
    got = exact_percentiles(df, "v", {"p1": 1, "p50": 50, "p99": 99, "p100": 100}, 100).first()
    for name, p in (("p1", 1), ("p50", 50), ("p99", 99), ("p100", 100)):
        assert got[name] == ordered[-(-len(ordered) * p // 100) - 1]


def visitors_of(make, rows):
    return vi.visitor_profiles(sessions_of(make(rows)))


def test_first_touch_and_edges(make):
    buy = [hit(1, "6")]
    rows = [
        row("a", 1, "2017-01-01", [], channel="Social", number=1), row("a", 9, "2017-01-06", buy, channel="Direct", number=2),
        row("b", 5, "2017-01-10", buy, channel="Direct", number=3),
        row("c", 7, "2017-01-10", [], channel="Social", number=1),
    ]
    v = visitors_of(make, rows)
    assert {(r.fullVisitorId, r.first_channel) for r in vi.first_touch(v).collect()} == {
        ("a", "Social"), ("b", "Direct"), ("c", "Social")}
    shift = {r.channel: r for r in vi.attribution_shift(v).collect()}
    assert (shift["Direct"].last_click, shift["Direct"].first_touch) == (2, 1)
    assert (shift["Social"].last_click, shift["Social"].first_touch) == (0, 1)
    index = vi.first_seen(sessions_of(make(rows)))
    assert tuple(vi.left_truncated(v, index).first())[:2] == (3, 1)
    assert vi.untruncated(v, index).count() == 2 and vi.multi_session(v).count() == 1
    edge = vi.right_edge(v).first()
    assert (edge.horizon_days, edge.window_end, edge.visitors, edge.kept, edge.dropped) == (5, "2017-01-10", 3, 1, 2)
    assert [r.fullVisitorId for r in vi.observable_visitors(v).collect()] == ["a"]
    medians = {r.first_channel: r.median_visits for r in vi.visits_to_purchase(sessions_of(make(rows)), v).collect()}
    assert medians == {"Social": 2.0, "Direct": 3.0}


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 10, 3), (2, 10, 2), (3, 5, 2), (4, 1, 1)], "k int, a int, b int")
    import pandas as pd

    p = df.toPandas()
    want = p.a.rank().corr(p.b.rank())
    assert abs(vi.spearman(df, "a", "b").first().rho - want) < 1e-12
    same = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert vi.spearman(same, "a", "b").first().rho is None
