"""The whole report: every named result from one pass of preparation.

Sessions and transactions are built once and written to the session's shared
folder, so that the results below read narrow tables, and a lost executor costs
a re-read rather than a rebuild. Results are written as CSV, rounded there and
nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import attribution as at
from ..operators import funnel as fu
from ..operators import quality as qu
from ..operators import segments as sg
from ..operators import sessions as se
from ..sources.schemas import RESULTS
from ..sources.tables import shared_dir, write_result

# Digits of the published ratios, by result and column.
DIGITS: dict[str, dict[str, int]] = {
    "01_unknown_channels": {"pct_unknown_channel": 2},
    "03_funnel_steps": {"pct_purchase_without_view": 2},
    "04b_tx_duplicates_examples": {"revenue_sum_if_naive": 2},
    "05_revenue_distribution": {"min_usd": 2, "p50_usd": 2, "p95_usd": 2, "p99_usd": 2, "max_usd": 2},
    "05b_revenue_source_of_truth": {"session_level_usd": 2, "hit_level_usd": 2},
    "06_null_pageviews": {"pct_pageviews_null": 3},
    "07_suspicious_sources": {"conversion_pct": 2},
    "11_channel_composition": {"pct_of_channel": 1},
    "11b_channel_concentration": {"top_source_pct": 1},
    "14_monotonic_confound": {"pct_no_view": 2, "pct_buyers_no_view": 2},
    "15_direct_source_vs_channel": {
        "pct_direct_sourced": 1, "pct_return_direct": 1, "pct_return_rest": 1, "pct_true_direct": 1,
        "pct_referral_path": 1,
    },
    "15b_funnel_by_direct_sourced": {"cr_pct": 3},
    "16_referral_path_hidden_direct": {"cr_pct": 2, "pct_returning": 1},
    "17_hidden_direct_network": {"cr_pct": 2},
    "17b_hidden_direct_concentration": {"sessions_per_visitor": 2, "pct_purchases_from_3plus": 1},
    "22_monotonic_confound_device": {"pct_no_view": 2, "pct_buyers_no_view": 2},
    "25_channel_device_cross": {"cr_pct": 3},
    "26_return_share_by_channel": {"pct_returning": 1},
}


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def results(rows: DataFrame, hits: DataFrame, sessions: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Every named result over prepared tables, as thunks."""
    P = se.population(sessions)
    return {
        "01_unknown_channels": lambda: qu.unknown_channels(rows),
        "02_session_duplicates": lambda: qu.session_duplicates(rows),
        "03_funnel_steps": lambda: qu.funnel_gaps(qu.session_steps(rows)),
        "04_tx_duplicates": lambda: qu.tx_duplicates(hits),
        "04b_tx_duplicates_examples": lambda: qu.tx_duplicate_examples(hits),
        "05_revenue_distribution": lambda: qu.revenue_distribution(rows),
        "05b_revenue_source_of_truth": lambda: qu.revenue_source_of_truth(rows),
        "06_null_pageviews": lambda: qu.null_pageviews(rows),
        "07_suspicious_sources": lambda: qu.suspicious_sources(rows),
        "08_session_key_check": lambda: qu.session_key_check(rows),
        "09_internal_google_full": lambda: qu.internal_sources(rows),
        "10_tx_revenue_hits": lambda: qu.tx_hits(hits, qu.tx_duplicate_examples(hits, 2)),
        "10b_rev_hits_distribution": lambda: qu.rev_hits_distribution(hits),
        "11_channel_composition": lambda: fu.channel_composition(P),
        "11b_channel_concentration": lambda: fu.channel_concentration(P),
        "11c_google_subdomains_medium": lambda: fu.internal_medium(rows),
        "12_funnel_by_channel": lambda: fu.funnel_by(P, "channel"),
        "13_exclusions_reconciliation": lambda: fu.exclusions_reconciliation(sessions),
        "14_monotonic_confound": lambda: fu.monotone_confound(P, "channel"),
        "15_direct_source_vs_channel": lambda: at.direct_source_vs_channel(P),
        "15b_funnel_by_direct_sourced": lambda: at.funnel_by_direct_sourced(P),
        "16_referral_path_hidden_direct": lambda: at.hidden_direct_paths(sessions),
        "16b_hidden_direct_landing": lambda: at.hidden_direct_landing(rows),
        "17_hidden_direct_network": lambda: at.hidden_direct_network(P),
        "17b_hidden_direct_concentration": lambda: at.hidden_direct_concentration(P),
        "21_funnel_by_device": lambda: fu.funnel_by(P, "device"),
        "22_monotonic_confound_device": lambda: fu.monotone_confound(P, "device"),
        "23_funnel_by_returning": lambda: fu.funnel_by(se.with_visitor_type(P), "visitor_type", ["mono"]),
        "24_top_countries": lambda: fu.funnel_top_groups(P, "country", 5),
        "25_channel_device_cross": lambda: sg.channel_device_cross(P),
        "26_return_share_by_channel": lambda: sg.return_share(P),
        "27_funnel_by_device_variants": lambda: fu.funnel_by_variants(P, "device", sg.sample_variants()),
    }


def write_report(spark: SparkSession, rows: DataFrame, hits: DataFrame, folder: str) -> list[str]:
    """Write all named results under `folder`; returns their names.

    `rows` are row facts and `hits` hit facts (those with a transaction are
    enough), from nested session rows or from the event log.
    """
    rows = _stored(rows, "rows")
    hits = _stored(hits.where("tx_id IS NOT NULL"), "transaction-hits")
    sessions = _stored(se.behavioural_sessions(rows), "sessions")
    made = results(rows, hits, sessions)
    for name, build in made.items():
        published = [column.split(" ")[0] for column in RESULTS[name].split(", ")]
        write_result(build().select(published), f"{folder}/{name}", DIGITS.get(name))
    return list(made)
