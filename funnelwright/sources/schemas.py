"""Declared schemas, as DDL: the nested session table and the published result tables."""

from __future__ import annotations

HIT = (
    "hitNumber: bigint, type: string, page: struct<pagePath: string>, "
    "eCommerceAction: struct<action_type: string>, "
    "transaction: struct<transactionId: string, transactionRevenue: bigint>"
)

# `piece` numbers the parts of a row whose hits are stored in several; NULL (or no such column) is a whole row.
RAW_SESSION = (
    "fullVisitorId string, visitId bigint, date string, visitNumber bigint, channelGrouping string, "
    "trafficSource struct<source: string, medium: string, isTrueDirect: boolean, referralPath: string>, "
    "device struct<deviceCategory: string>, "
    "geoNetwork struct<country: string, networkDomain: string>, "
    "totals struct<hits: bigint, pageviews: bigint, transactions: bigint, "
    "transactionRevenue: bigint, newVisits: bigint>, "
    f"hits array<struct<{HIT}>>, piece int"
)

# The flat event log of the test tables.
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

_MONO = "viewed_mono bigint, cart_mono bigint, checkout_mono bigint, purchase_mono bigint"
_STRICT = "viewed_strict bigint, cart_strict bigint, checkout_strict bigint, purchase_strict bigint"
_CONFOUND = (
    "sessions_with_hits bigint, no_view_event bigint, pct_no_view double, "
    "purchase_sessions bigint, buyers_no_view bigint, pct_buyers_no_view double"
)

# Columns of every published result, by result name.
RESULTS: dict[str, str] = {
    "01_unknown_channels": "sessions bigint, unknown_channel bigint, medium_none_or_notset bigint, "
    "source_direct bigint, pct_unknown_channel double",
    "02_session_duplicates": "rows_total bigint, distinct_sessions bigint, distinct_visitors bigint",
    "03_funnel_steps": "purchase_sessions bigint, purchase_without_view bigint, "
    "purchase_without_cart bigint, purchase_without_checkout bigint, pct_purchase_without_view double",
    "04_tx_duplicates": "distinct_transaction_ids bigint, ids_in_multiple_hits bigint, "
    "ids_in_multiple_sessions bigint",
    "04b_tx_duplicates_examples": "tx_id string, hit_rows bigint, sessions_per_tx bigint, "
    "revenue_sum_if_naive double",
    "05_revenue_distribution": "sessions bigint, revenue_null bigint, revenue_zero bigint, "
    "revenue_negative bigint, min_usd double, p50_usd double, p95_usd double, p99_usd double, max_usd double",
    "05b_revenue_source_of_truth": "session_level_usd double, hit_level_usd double",
    "06_null_pageviews": "sessions bigint, pageviews_null bigint, hits_null bigint, "
    "null_pageviews_with_revenue bigint, pct_pageviews_null double",
    "07_suspicious_sources": "source string, medium string, sessions bigint, purchase_sessions bigint, "
    "conversion_pct double",
    "08_session_key_check": "rows_total bigint, key_2 bigint, key_3 bigint",
    "09_internal_google_full": "source string, medium string, sessions bigint, purchase_sessions bigint",
    "10_tx_revenue_hits": "tx_id string, hitNumber bigint, action_type string, rev double",
    "10b_rev_hits_distribution": "rev_hits bigint, tx_count bigint",
    "11_channel_composition": "channel string, source string, medium string, sessions bigint, "
    "pct_of_channel double",
    "11b_channel_concentration": "channel string, sessions bigint, distinct_sources bigint, "
    "top_source string, top_source_pct double",
    "11c_google_subdomains_medium": "medium string, sessions bigint",
    "12_funnel_by_channel": f"channel string, sessions bigint, {_MONO}, {_STRICT}",
    "13_exclusions_reconciliation": "sessions_all bigint, excl_no_channel bigint, "
    "excl_internal_google bigint, excl_overlap bigint, sessions_kept bigint",
    "14_monotonic_confound": f"channel string, {_CONFOUND}",
    "15_direct_source_vs_channel": "channel string, sessions bigint, direct_sourced bigint, "
    "pct_direct_sourced double, pct_return_direct double, pct_return_rest double, "
    "pct_true_direct double, pct_referral_path double",
    "15b_funnel_by_direct_sourced": "channel string, bucket string, sessions bigint, "
    "viewed_or_purchased bigint, purchases bigint, cr_pct double",
    "16_referral_path_hidden_direct": "referral_path string, sessions bigint, purchases bigint, "
    "cr_pct double, pct_returning double",
    "16b_hidden_direct_landing": "landing_page string, sessions bigint",
    "17_hidden_direct_network": "grp string, net_domain string, sessions bigint, purchases bigint, "
    "cr_pct double",
    "17b_hidden_direct_concentration": "grp string, visitors bigint, sessions bigint, purchases bigint, "
    "sessions_per_visitor double, buyers bigint, buyers_3plus bigint, pct_purchases_from_3plus double",
    "21_funnel_by_device": f"device string, sessions bigint, {_MONO}, {_STRICT}",
    "22_monotonic_confound_device": f"device string, {_CONFOUND}",
    "23_funnel_by_returning": f"visitor_type string, sessions bigint, {_MONO}",
    "24_top_countries": f"country string, sessions bigint, {_MONO}",
    "25_channel_device_cross": "channel string, device string, sessions bigint, viewed_strict bigint, "
    "purchase_mono bigint, cr_pct double",
    "26_return_share_by_channel": "channel string, sessions bigint, returning_sessions bigint, "
    "pct_returning double",
    "27_funnel_by_device_variants": f"variant string, device string, sessions bigint, {_MONO}, {_STRICT}",
}
