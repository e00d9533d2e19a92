"""Every named query over the test tables: (spark, folder) -> DataFrame.

Rounding: float sums depend on the order of their terms, so queries that end
in one are rounded here, far below any meaning; the operators are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import is_internal
from ..operators import attribution as at
from ..operators import bootstrap as bs
from ..operators import funnel as fu
from ..operators import metrics as me
from ..operators import quality as qu
from ..operators import segments as sg
from ..operators import sessions as se
from ..operators import stats as st
from ..operators import visitors as vi
from ..sources.events import hits_from_events, nested_from_events, rows_from_events, transaction_sessions_from_events
from ..sources.schemas import EVENTS, RESULTS
from ..sources.tables import (
    read_optional,
    read_result,
    read_sessions,
    shared_dir,
    stored,
    write_bucketed_sessions,
    write_result,
    write_sessions,
)

Query = Callable[[SparkSession, str], DataFrame]

DEVICES = ("desktop", "mobile", "tablet")
# Replicates of the registered bootstrap queries.
REPS = 1000
FIRST_DAY, LAST_DAY = "2024-01-08", "2024-01-21"


# ---- inputs ----------------------------------------------------------------

def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows_from_events(events(spark, folder))


def tx_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return transaction_sessions_from_events(events(spark, folder))


def nested(spark: SparkSession, folder: str) -> DataFrame:
    return nested_from_events(events(spark, folder))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return se.behavioural_sessions(rows(spark, folder))


def population(spark: SparkSession, folder: str) -> DataFrame:
    return se.population(sessions(spark, folder))


def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return vi.first_seen(sessions(spark, folder))


def visitors(spark: SparkSession, folder: str) -> DataFrame:
    return vi.visitor_profiles(population(spark, folder))


def _on(source: Query, operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """Query that applies one operator to one input."""
    return lambda spark, folder: operator(source(spark, folder), *args, **kwargs)


def _rounded(query: Query, digits: int, *names: str) -> Query:
    return lambda spark, folder: query(spark, folder).withColumns({n: F.round(n, digits) for n in names})


# ---- sources and sinks -----------------------------------------------------

def stored_sessions_by_day(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "sessions")
    write_sessions(nested(spark, folder), path)
    stored = se.row_facts(read_sessions(spark, path, FIRST_DAY, LAST_DAY))
    return stored.groupBy("date").agg(
        F.count("*").alias("rows_of_day"),
        F.sum("n_hits").alias("hits_of_day"),
        F.sum("purchase_raw").cast("bigint").alias("purchase_rows"),
    )


def bucketed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Behavioural sessions read from a session table in buckets of visitors."""
    path = shared_dir(spark, "bucketed-sessions")
    name = "sessions_" + path.rsplit("-", 1)[1]
    write_bucketed_sessions(nested(spark, folder), name, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return se.behavioural_sessions(se.row_facts(spark.table(name), in_place=True))


def stored_result(query: Query, name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = shared_dir(spark, name)
        write_result(query(spark, folder), path)
        return read_result(spark, path, RESULTS[name])

    return run


def stored_optional(query: Query, name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = shared_dir(spark, name)
        write_result(query(spark, folder), path)
        found = read_optional(spark, path, RESULTS[name])
        return found if found is not None else spark.createDataFrame([], RESULTS[name])

    return run


# ---- shared transformations ------------------------------------------------

KEY = ["fullVisitorId", "visitId"]
FLAGS = ["view_raw", "cart_raw", "checkout_raw", "purchase_raw"]


def step_flags(spark: SparkSession, folder: str) -> DataFrame:
    return se.row_facts(nested(spark, folder)).select(*KEY, "date", "n_hits", *FLAGS)


def steps_exploded(spark: SparkSession, folder: str) -> DataFrame:
    return se.session_steps_exploded(se.hit_facts(nested(spark, folder), ["action_type"]))


def internal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows(spark, folder).select(*KEY, "date", "source", is_internal("source").alias("internal"))


def landing_pages(spark: SparkSession, folder: str) -> DataFrame:
    return se.row_facts(nested(spark, folder)).select(*KEY, "date", "landing_page")


def monotone(spark: SparkSession, folder: str) -> DataFrame:
    return se.with_monotone(population(spark, folder)).select(*KEY, *fu.reached_step_names("mono"))


def strict(spark: SparkSession, folder: str) -> DataFrame:
    return se.with_strict(population(spark, folder)).select(*KEY, *fu.reached_step_names("strict"))


def variant_sizes(spark: SparkSession, folder: str) -> DataFrame:
    varied = se.with_variants(population(spark, folder), sg.sample_variants())
    return varied.groupBy("variant").agg(F.count("*").alias("sessions"))


def masked_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = sg.channel_device_cross(population(spark, folder))
    return se.min_cell(cells, "sessions", mask=["cr_pct"]).select("channel", "device", "sessions", "cr_pct")


def country_totals(spark: SparkSession, folder: str) -> DataFrame:
    return se.rollup_total(sessions(spark, folder), "country", {"sessions": F.count("*")})


# ---- named queries ---------------------------------------------------------

def reissued_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The two most re-issued transactions, hit by hit."""
    bought = stored(tx_sessions(spark, folder), "transactions")
    visits = bought.join(qu.tx_duplicate_examples(bought, 2).select("tx_id"), "tx_id", "left_semi")
    return qu.tx_hits(hits_from_events(events(spark, folder), visits=visits), visits)


funnel_by_channel = _on(population, fu.funnel_by, "channel")
funnel_by_device = _on(population, fu.funnel_by, "device")
funnel_by_visitor_type: Query = lambda spark, folder: fu.funnel_by(
    se.with_visitor_type(population(spark, folder)), "visitor_type", ["mono"]
)
funnel_by_country = _on(population, fu.funnel_top_groups, "country", 5)
funnel_variants: Query = lambda spark, folder: fu.funnel_by_variants(
    population(spark, folder), "device", sg.sample_variants()
)
gaps: Query = lambda spark, folder: qu.funnel_gaps(qu.session_steps(rows(spark, folder)))
cross = _on(population, sg.channel_device_cross)
truth = _on(rows, qu.revenue_source_of_truth)
rev_hits = _on(tx_sessions, qu.rev_hits_distribution)
exclusions = _on(sessions, fu.exclusions_reconciliation)

NAMED: dict[str, Query] = {
    "q01_unknown_channels": _on(rows, qu.unknown_channels),
    "q02_session_duplicates": _on(rows, qu.session_duplicates),
    "q03_funnel_steps": gaps,
    "q04_tx_duplicates": _on(tx_sessions, qu.tx_duplicates),
    "q04b_tx_duplicates_examples": _on(tx_sessions, qu.tx_duplicate_examples),
    "q05_revenue_distribution": _on(rows, qu.revenue_distribution),
    "q05b_revenue_source_of_truth": truth,
    "q06_null_pageviews": _on(rows, qu.null_pageviews),
    "q07_suspicious_sources": _on(rows, qu.suspicious_sources),
    "q08_session_key_check": _on(rows, qu.session_key_check),
    "q09_internal_google_full": _on(rows, qu.internal_sources),
    "q10_tx_revenue_hits": reissued_hits,
    "q10b_rev_hits_distribution": rev_hits,
    "q11_channel_composition": _on(population, fu.channel_composition),
    "q11b_channel_concentration": _on(population, fu.channel_concentration),
    "q11c_google_subdomains_medium": _on(rows, fu.internal_medium),
    "q12_funnel_by_channel": funnel_by_channel,
    "q13_exclusions_reconciliation": exclusions,
    "q14_monotonic_confound": _on(population, fu.monotone_confound, "channel"),
    "q15_direct_source_vs_channel": _on(population, at.direct_source_vs_channel),
    "q15b_funnel_by_direct_sourced": _on(population, at.funnel_by_direct_sourced),
    "q16_referral_path_hidden_direct": _on(sessions, at.hidden_direct_paths),
    "q16b_hidden_direct_landing": _on(rows, at.hidden_direct_landing),
    "q17_hidden_direct_network": _on(population, at.hidden_direct_network),
    "q17b_hidden_direct_concentration": _on(population, at.hidden_direct_concentration),
    "q21_funnel_by_device": funnel_by_device,
    "q22_monotonic_confound_device": _on(population, fu.monotone_confound, "device"),
    "q23_funnel_by_returning": funnel_by_visitor_type,
    "q24_top_countries": funnel_by_country,
    "q25_channel_device_cross": cross,
    "q26_return_share_by_channel": _on(population, sg.return_share),
    "q27_funnel_by_device_variants": funnel_variants,
}

# ---- derived figures -------------------------------------------------------

long_channel = _on(funnel_by_channel, me.step_lines, "channel")
long_device = _on(funnel_by_device, me.step_lines, "device")
long_visitor = _on(funnel_by_visitor_type, me.step_lines, "visitor_type", ["mono"])
device_gap = _on(long_device, me.gap, "device", "desktop", "mobile")
visitor_gap = _on(long_visitor, me.gap, "visitor_type", "returning", "new")
PAIR = ["version", "step", "cr_a", "cr_b", "gap_pp", "ratio", "largest", "smallest"]

DERIVED: dict[str, Query] = {
    "m01_volume": _on(rows, qu.volume),
    "m02_origin_share": _on(rows, qu.origin_share),
    "m03_key_diagnosis": _on(rows, qu.key_diagnosis),
    "m04_missing_steps": _on(gaps, qu.missing_steps),
    "m05_purchase_reconciliation": lambda s, d: qu.purchase_reconciliation(
        gaps(s, d), qu.tx_duplicates(tx_sessions(s, d)), qu.revenue_distribution(rows(s, d))
    ),
    "m06_revenue_gap": _on(truth, qu.revenue_gap),
    "m07_reissue_summary": lambda s, d: qu.reissue_summary(rev_hits(s, d), truth(s, d)),
    "m08_internal_split": lambda s, d: qu.internal_split(qu.internal_sources(rows(s, d))),
    "m08b_internal_share": lambda s, d: qu.internal_share(sessions(s, d)),
    "m09_direct_reassigned": _on(population, at.direct_reassigned),
    "m10_check_exclusions": _on(exclusions, me.check_exclusions),
    "m11_long_funnel": lambda s, d: long_channel(s, d).drop("step_no"),
    "m12_rate_matrix": _on(long_channel, me.rate_matrix, "channel"),
    "m13_loss_waterfall": _on(long_channel, me.loss_waterfall, "channel"),
    "m14_entry_loss": _on(funnel_by_channel, me.entry_loss_excluding, "channel", "Social"),
    "m15_spread": _on(long_channel, me.spread, "channel"),
    "m16_version_gap": _on(long_channel, me.version_gap, "channel"),
    "m17_check_monotone": _on(long_channel, me.check_monotone, "channel"),
    "m18_confound_range": lambda s, d: me.confound_range(fu.monotone_confound(population(s, d), "channel"), "channel"),
    "m19_origin_matrix": lambda s, d: at.origin_matrix(at.funnel_by_direct_sourced(population(s, d))),
    "m20_path_share": _on(sessions, at.path_share, "/"),
    "m21_domain_share": _on(population, at.domain_share, "(not set)"),
    "m22_device_gap": lambda s, d: device_gap(s, d).select(*PAIR),
    "m22b_device_gap_extremes": _on(device_gap, me.gap_extremes),
    "m23_device_ratio": _on(long_device, me.step_ratio, "device", "desktop", "mobile"),
    "m24_backfill": _on(funnel_by_device, me.backfill, "device"),
    "m25_visitor_type_gap": lambda s, d: visitor_gap(s, d).select(*PAIR),
    "m26_thin_steps": _on(funnel_by_country, sg.thin_steps),
    "m27_masked_cross": _on(cross, sg.masked_cross, DEVICES),
    "m27b_cross_cell_counts": _on(cross, sg.cross_cell_counts),
    "m27c_ranked_cells": _on(cross, sg.ranked_cells),
    "m28_check_returning": _on(population, sg.check_returning),
    "m29_cross_variants": _on(cross, sg.cross_variants),
    "m30_variant_removed": _on(funnel_variants, sg.variant_removed),
    "m31_variant_gaps": _on(funnel_variants, sg.variant_gaps),
    "m32_check_total": lambda s, d: me.check_total(funnel_by_device(s, d), "device", exclusions(s, d)),
}

# ---- statistics ------------------------------------------------------------

def _varied(spark: SparkSession, folder: str) -> DataFrame:
    """Population once per sensitivity sample."""
    return se.with_variants(population(spark, folder), sg.sensitivity_variants())


def _variant_long(spark: SparkSession, folder: str) -> DataFrame:
    funnel = fu.funnel_by_variants(population(spark, folder), "channel", sg.sensitivity_variants())
    return me.step_lines(funnel, "channel", by=["variant"])


def _hidden_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Population in the two samples of the device test: all, and without hidden Referral."""
    both = {k: v for k, v in sg.sample_variants().items() if k in ("all", "no_hidden_referral")}
    return se.with_variants(population(spark, folder), both)


def _z_tests(spark: SparkSession, folder: str) -> DataFrame:
    funnel = fu.funnel_by_variants(
        population(spark, folder), "device",
        {k: v for k, v in sg.sample_variants().items() if k in ("all", "no_hidden_referral")},
    )
    return st.z_test(me.step_lines(funnel, "device", by=["variant"]), "device", "desktop", "mobile", by=["variant"])


varied_shift: Query = lambda s, d: vi.attribution_shift(
    vi.visitor_profiles(_varied(s, d), ["variant"]), ["variant"]
)
shift = _on(visitors, vi.attribution_shift)
chi = _on(long_channel, st.chi_square, "channel")
holm_p = ["version", "step", "p_value", "p_holm", "significant"]

STATISTICS: dict[str, Query] = {
    "s01_chi_square": _rounded(
        lambda s, d: chi(s, d).select("version", "step", "groups", "n", "df", "chi2", "p_value"), 8, "chi2", "p_value"
    ),
    "s02_cramers_v": _rounded(_on(long_channel, st.cramers_v, "channel"), 9, "cramers_v"),
    "s03_holm": _rounded(lambda s, d: chi(s, d).select(*holm_p), 8, "p_value", "p_holm"),
    "s04_bootstrap_v": _rounded(
        _on(population, bs.bootstrap_v_diff, "channel", REPS), 9, "estimate", "low", "high"
    ),
    "s04b_bootstrap_v_sessions": _rounded(
        _on(population, bs.bootstrap_v_diff, "channel", REPS, unit="session"), 9, "estimate", "low", "high"
    ),
    "s04c_bootstrap_v_moments": _rounded(
        _on(population, bs.bootstrap_v_diff, "channel", REPS, method="moments"), 9, "estimate", "low", "high"
    ),
    "s05_z_test": _rounded(lambda s, d: _z_tests(s, d).drop("step_no"), 8, "z", "p_value", "p_holm"),
    "s06_bootstrap_gap": _rounded(
        _on(_hidden_pair, bs.bootstrap_gap_diff, "device", "desktop", "mobile", REPS, by=["variant"]),
        9, "estimate", "low", "high",
    ),
    "s06b_bootstrap_gap_moments": _rounded(
        _on(_hidden_pair, bs.bootstrap_gap_diff, "device", "desktop", "mobile", REPS, by=["variant"], method="moments"),
        9, "estimate", "low", "high",
    ),
    "s07_cv_compare": _rounded(
        _on(population, st.cv_compare), 9, "cv_conversion", "cv_order_value", "cv_ratio"
    ),
    "s08_revenue_by_channel": _on(population, st.revenue_by, "channel"),
    "s09_first_touch": _on(visitors, vi.first_touch),
    "s10_attribution_shift": shift,
    "s10b_attribution_verdict": _on(shift, vi.attribution_verdict),
    "s11_spearman": _rounded(_on(shift, vi.spearman, "last_click", "first_touch"), 9, "rho"),
    "s12_bootstrap_spearman": _rounded(
        _on(visitors, bs.bootstrap_spearman, REPS), 9, "estimate", "low", "high"
    ),
    "s12b_bootstrap_spearman_moments": _rounded(
        _on(visitors, bs.bootstrap_spearman, REPS, method="moments"), 9, "estimate", "low", "high"
    ),
    "s12c_bootstrap_spearman_slices": _rounded(
        lambda s, d: bs.bootstrap_spearman(vi.with_slices(visitors(s, d), first_seen(s, d)), REPS, by=["slice"], method="moments"),
        9, "estimate", "low", "high",
    ),
    "s13_purchase_visit_numbers": _on(population, vi.purchase_visit_numbers),
    "s13b_visits_to_purchase": lambda s, d: vi.visits_to_purchase(population(s, d), visitors(s, d)),
    "s14_right_edge": _on(visitors, vi.right_edge),
    "s14b_observable_shift": lambda s, d: vi.attribution_shift(vi.observable_visitors(visitors(s, d))),
    "s15_left_truncated": lambda s, d: vi.left_truncated(visitors(s, d), first_seen(s, d)),
    "s15b_untruncated_shift": lambda s, d: vi.attribution_shift(vi.untruncated(visitors(s, d), first_seen(s, d))),
    "s16_multi_session_shift": lambda s, d: vi.attribution_shift(vi.multi_session(visitors(s, d))),
    "s16b_slice_spearman": _rounded(
        lambda s, d: vi.spearman(
            vi.attribution_shift(vi.with_slices(visitors(s, d), first_seen(s, d)), ["slice"]), "last_click", "first_touch", ["slice"]
        ),
        9, "rho",
    ),
    "s17_sensitivity_v": _rounded(
        _on(_variant_long, st.cramers_v, "channel", by=["variant"]), 9, "cramers_v"
    ),
    "s17b_sensitivity_cv": _rounded(
        lambda s, d: st.cv_compare(population(s, d), variants=sg.sensitivity_variants()), 9, "cv_conversion", "cv_order_value", "cv_ratio"
    ),
    "s17c_sensitivity_shift": varied_shift,
    "s17d_sensitivity_spearman": _rounded(
        _on(varied_shift, vi.spearman, "last_click", "first_touch", ["variant"]), 9, "rho"
    ),
    "s17e_sensitivity_bootstrap": _rounded(
        _on(_varied, bs.bootstrap_v_diff, "channel", REPS, by=["variant"]), 9, "estimate", "low", "high"
    ),
    "s04d_bootstrap_v_strict": _rounded(
        _on(population, bs.bootstrap_v_diff, "channel", REPS, version="strict", method="moments"), 9, "estimate", "low", "high"
    ),
    "s06c_bootstrap_gap_strict": _rounded(
        _on(_hidden_pair, bs.bootstrap_gap_diff, "device", "desktop", "mobile", REPS, version="strict", by=["variant"], method="moments"),
        9, "estimate", "low", "high",
    ),
    "s02b_through_conversion": _rounded(_on(long_channel, st.through_conversion, "channel"), 8, "chi2", "cramers_v", "p_value"),
    "s17f_sensitivity_bootstrap_moments": _rounded(
        _on(_varied, bs.bootstrap_v_diff, "channel", REPS, by=["variant"], method="moments"), 9, "estimate", "low", "high"
    ),
    "s18_referral_two_ways": _on(sessions, sg.referral_two_ways),
    "s19_testable_cells": lambda s, d: st.testable_cells(long_channel(s, d), "channel").select(
        "version", "channel", "step", "prev_n", "tested"
    ),
}

SOURCES: dict[str, Query] = {
    "a01_read_sessions": stored_sessions_by_day,
    "a02_read_result": stored_result(funnel_by_channel, "12_funnel_by_channel"),
    "a03_read_optional": stored_optional(cross, "25_channel_device_cross"),
    "a04_write_result": stored_result(NAMED["q26_return_share_by_channel"], "26_return_share_by_channel"),
}

TRANSFORMS: dict[str, Query] = {
    "b01_step_flags": step_flags,
    "b02_steps_exploded": steps_exploded,
    "b03_behavioural_sessions": sessions,
    "b03b_bucketed_sessions": bucketed_sessions,
    "b04_population": lambda s, d: population(s, d).select(*KEY, "channel", "source"),
    "b05_internal_source": internal_rows,
    "b06_monotone": monotone,
    "b07_strict": strict,
    "b08_direct_sourced": lambda s, d: se.with_direct_sourced(sessions(s, d)).select(*KEY, "direct_sourced"),
    "b09_hidden_direct": lambda s, d: se.with_hidden_direct(sessions(s, d)).select(*KEY, "grp"),
    "b10_visitor_type": lambda s, d: se.with_visitor_type(rows(s, d)).select(*KEY, "date", "visitor_type"),
    "b11_landing_page": landing_pages,
    "b12_normalised_origin": lambda s, d: se.normalise_origin(rows(s, d)).select(
        *KEY, "date", "source", "medium", "net_domain"
    ),
    "b13_sample_variants": variant_sizes,
    "b14_min_cell": masked_cells,
    "b15_rollup_total": country_totals,
}

QUERIES: dict[str, Query] = {**SOURCES, **TRANSFORMS, **NAMED, **DERIVED, **STATISTICS}
