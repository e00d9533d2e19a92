"""Data-quality checks: origin, keys, funnel gaps, transactions, revenue.

Row-level checks count rows (visit and day), as their names in the docstrings
say; transaction checks take hit facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import exact_percentiles, side_by_side
from ..functions.rules import MIN_CELL, RAW_FLAGS, is_internal, is_unknown_channel, pct, ratio, usd
from ..sources.tables import stored
from .sessions import ROW_KEY, SESSION_KEY

# Fixed value: internal sources with high conversion, told apart from the rest.
LISTED_INTERNAL = (
    "mail.google.com", "groups.google.com", "sites.google.com", "plus.google.com", "docs.google.com",
)


def unknown_channels(rows: DataFrame) -> DataFrame:
    """Rows without a channel, with an empty medium, with a direct source."""
    return rows.agg(
        F.count("*").alias("sessions"),
        F.count_if(is_unknown_channel("channel")).alias("unknown_channel"),
        F.count_if(F.col("medium").isin("(none)", "(not set)")).alias("medium_none_or_notset"),
        F.count_if(F.col("source") == "(direct)").alias("source_direct"),
    ).withColumn("pct_unknown_channel", pct(F.col("unknown_channel"), F.col("sessions")))


def _key_counts(rows: DataFrame) -> DataFrame:
    """Rows, distinct row keys, sessions and visitors, one level at a time.

    Nested grouping: nothing is expanded, and each level pre-aggregates.
    """
    by_row = rows.groupBy(*ROW_KEY).agg(F.count("*").alias("n"))
    by_session = by_row.groupBy(*SESSION_KEY).agg(F.sum("n").alias("n"), F.count("*").alias("k3"))
    by_visitor = by_session.groupBy("fullVisitorId").agg(
        F.sum("n").alias("n"), F.sum("k3").alias("k3"), F.count("*").alias("k2")
    )
    return by_visitor.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum("k3"), F.lit(0)).alias("key_3"),
        F.coalesce(F.sum("k2"), F.lit(0)).alias("key_2"),
        F.count("*").alias("visitors"),
    )


def session_duplicates(rows: DataFrame) -> DataFrame:
    """Rows against distinct sessions and visitors."""
    return _key_counts(rows).select(
        "rows_total", F.col("key_2").alias("distinct_sessions"), F.col("visitors").alias("distinct_visitors")
    )


def session_key_check(rows: DataFrame) -> DataFrame:
    """Does the date make the row key unique."""
    return _key_counts(rows).select("rows_total", "key_2", "key_3")


def funnel_gaps(steps: DataFrame) -> DataFrame:
    """Purchase sessions without an earlier step; `steps` has flags per session."""
    view, cart, checkout, purchase = (F.col(c) for c in RAW_FLAGS)
    return steps.agg(
        F.count_if(purchase == 1).alias("purchase_sessions"),
        F.count_if((purchase == 1) & (view == 0)).alias("purchase_without_view"),
        F.count_if((purchase == 1) & (cart == 0)).alias("purchase_without_cart"),
        F.count_if((purchase == 1) & (checkout == 0)).alias("purchase_without_checkout"),
    ).withColumn(
        "pct_purchase_without_view", pct(F.col("purchase_without_view"), F.col("purchase_sessions"))
    )


def session_steps(rows: DataFrame) -> DataFrame:
    """Flags per session from row facts; rows without hits are left out, as by an explode."""
    return (
        rows.where(F.col("n_hits") > 0).groupBy(*SESSION_KEY).agg(*[F.max(c).alias(c) for c in RAW_FLAGS])
    )


def transaction_sessions(hits: DataFrame) -> DataFrame:
    """Per transaction id and session: hits, hits with revenue, naive revenue sum."""
    return (
        hits.where(F.col("tx_id").isNotNull())
        .groupBy("tx_id", *SESSION_KEY)
        .agg(
            F.count("*").alias("hit_rows"),
            F.count("tx_revenue").alias("rev_hits"),
            F.sum("tx_revenue").alias("revenue"),
        )
    )


def transactions(source: DataFrame) -> DataFrame:
    """Per transaction id: hits, sessions, hits with revenue, naive revenue sum.

    `source` has hits, or already one line per id and session. Grouped by (id,
    session) first, so a hot id is split before it is merged.
    """
    per_session = source if "hit_rows" in source.columns else transaction_sessions(source)
    return per_session.groupBy("tx_id").agg(
        F.sum("hit_rows").alias("hit_rows"),
        F.count("*").alias("sessions_per_tx"),
        F.sum("rev_hits").alias("rev_hits"),
        F.sum("revenue").alias("revenue"),
    )


def tx_duplicates(hits: DataFrame) -> DataFrame:
    """Distinct transaction ids; ids in several hits; ids in several sessions."""
    return transactions(hits).agg(
        F.count("*").alias("distinct_transaction_ids"),
        F.count_if(F.col("hit_rows") > 1).alias("ids_in_multiple_hits"),
        F.count_if(F.col("sessions_per_tx") > 1).alias("ids_in_multiple_sessions"),
    )


def tx_duplicate_examples(hits: DataFrame, n: int = 20) -> DataFrame:
    """The `n` most re-issued transactions and the sum a naive query would give."""
    return (
        transactions(hits)
        .where(F.col("hit_rows") > 1)
        .select("tx_id", "hit_rows", "sessions_per_tx", usd(F.col("revenue")).alias("revenue_sum_if_naive"))
        .orderBy(F.desc("hit_rows"), "tx_id")
        .limit(n)
    )


def revenue_distribution(rows: DataFrame) -> DataFrame:
    """Row revenue: NULL / zero / negative counts, minimum, exact percentiles, maximum."""
    rev = F.col("revenue")
    rows = stored(rows.select("revenue"), "revenue")
    counts = rows.agg(
        F.count("*").alias("sessions"),
        F.count_if(rev.isNull()).alias("revenue_null"),
        F.count_if(rev == 0).alias("revenue_zero"),
        F.count_if(rev < 0).alias("revenue_negative"),
        F.min("revenue").alias("min"),
        F.max("revenue").alias("max"),
    )
    percentiles = exact_percentiles(rows, "revenue", {"p50": 50, "p95": 95, "p99": 99})
    return side_by_side(counts, percentiles).select(
        "sessions",
        "revenue_null",
        "revenue_zero",
        "revenue_negative",
        *[usd(F.col(c)).alias(f"{c}_usd") for c in ("min", "p50", "p95", "p99", "max")],
    )


def revenue_distribution_approx(rows: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """As `revenue_distribution`, in one pass, with approximate percentiles."""
    rev = F.col("revenue")
    p = F.percentile_approx("revenue", [0.5, 0.95, 0.99], accuracy)
    return rows.agg(
        F.count("*").alias("sessions"),
        F.count_if(rev.isNull()).alias("revenue_null"),
        F.count_if(rev == 0).alias("revenue_zero"),
        F.count_if(rev < 0).alias("revenue_negative"),
        usd(F.min("revenue")).alias("min_usd"),
        *[usd(p[i]).alias(f"{name}_usd") for i, name in enumerate(("p50", "p95", "p99"))],
        usd(F.max("revenue")).alias("max_usd"),
    )


def revenue_source_of_truth(rows: DataFrame) -> DataFrame:
    """Revenue on rows against revenue summed over hits, in one scan."""
    return rows.agg(
        usd(F.sum("revenue")).alias("session_level_usd"), usd(F.sum("hit_revenue")).alias("hit_level_usd")
    )


def null_pageviews(rows: DataFrame) -> DataFrame:
    """Rows with NULL pageviews or hits, and whether any carries revenue."""
    no_pages = F.col("pageviews").isNull()
    return rows.agg(
        F.count("*").alias("sessions"),
        F.count_if(no_pages).alias("pageviews_null"),
        F.count_if(F.col("total_hits").isNull()).alias("hits_null"),
        F.count_if(no_pages & F.col("revenue").isNotNull()).alias("null_pageviews_with_revenue"),
    ).withColumn("pct_pageviews_null", pct(F.col("pageviews_null"), F.col("sessions")))


def _by_origin(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "medium").agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("transactions").isNotNull()).alias("purchase_sessions"),
    )


def suspicious_sources(rows: DataFrame, min_rows: int = MIN_CELL, n: int = 30) -> DataFrame:
    """Source and medium by conversion, top `n` of those with enough rows."""
    return (
        _by_origin(rows)
        .where(F.col("sessions") >= min_rows)
        .withColumn("conversion_pct", pct(F.col("purchase_sessions"), F.col("sessions")))
        .orderBy(F.desc("conversion_pct"), "source", "medium")
        .limit(n)
    )


def internal_sources(rows: DataFrame) -> DataFrame:
    """Every internal source by volume; no limit, so zero conversion shows too."""
    return _by_origin(rows.where(is_internal("source"))).orderBy(F.desc("sessions"), "source", "medium")


def tx_hits(hits: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """The hits of chosen transactions, in order; `ids` is a list or a frame with `tx_id`."""
    if isinstance(ids, DataFrame):
        chosen = hits.join(ids.select("tx_id"), "tx_id", "left_semi")
    else:
        chosen = hits.where(F.col("tx_id").isin(*ids))
    return chosen.select("tx_id", "hitNumber", "action_type", usd(F.col("tx_revenue")).alias("rev")).orderBy(
        "tx_id", "hitNumber"
    )


def rev_hits_distribution(hits: DataFrame) -> DataFrame:
    """How many transactions have 0, 1, 2, ... hits with revenue."""
    return transactions(hits).groupBy("rev_hits").agg(F.count("*").alias("tx_count")).orderBy("rev_hits")


# ---- derived figures -------------------------------------------------------

def volume(rows: DataFrame) -> DataFrame:
    """Rows, sessions, visitors, sessions per visitor."""
    return _key_counts(rows).select(
        "rows_total",
        F.col("key_2").alias("sessions"),
        "visitors",
        ratio(F.col("key_2"), F.col("visitors")).alias("sessions_per_visitor"),
    )


def origin_share(rows: DataFrame) -> DataFrame:
    """Unknown and direct rows as a share of distinct sessions, not of rows."""
    per_session = rows.groupBy(*SESSION_KEY).agg(
        F.count_if(is_unknown_channel("channel")).alias("unknown"),
        F.count_if(F.col("source") == "(direct)").alias("direct"),
    )
    return per_session.agg(
        F.count("*").alias("sessions"),
        F.sum("unknown").alias("unknown_channel"),
        F.sum("direct").alias("source_direct"),
    ).withColumns(
        {
            "pct_unknown": pct(F.col("unknown_channel"), F.col("sessions")),
            "pct_direct": pct(F.col("source_direct"), F.col("sessions")),
        }
    )


def key_diagnosis(rows: DataFrame) -> DataFrame:
    """Surplus rows of the session key, and whether the date explains them."""
    return _key_counts(rows).select(
        "rows_total",
        "key_2",
        "key_3",
        (F.col("rows_total") - F.col("key_2")).alias("surplus_rows"),
        pct(F.col("rows_total") - F.col("key_2"), F.col("rows_total")).alias("pct_surplus"),
        (F.col("key_3") == F.col("rows_total")).alias("date_makes_unique"),
    )


def missing_steps(gaps: DataFrame) -> DataFrame:
    """Share of purchases without view, cart, checkout; one line each."""
    steps = ("view", "cart", "checkout")
    return (
        gaps.select("purchase_sessions", *[F.col(f"purchase_without_{s}").alias(s) for s in steps])
        .unpivot("purchase_sessions", list(steps), "missing_step", "purchases")
        .withColumn("pct_of_purchases", pct(F.col("purchases"), F.col("purchase_sessions")))
    )


def purchase_reconciliation(gaps: DataFrame, tx: DataFrame, revenue: DataFrame) -> DataFrame:
    """Three near-equal purchase counts side by side, and the skew of revenue."""
    joined = side_by_side(
        gaps.select("purchase_sessions"),
        tx.select(F.col("distinct_transaction_ids").alias("transaction_ids")),
        revenue.select(
            (F.col("sessions") - F.col("revenue_null")).alias("sessions_with_revenue"),
            ratio(F.col("p99_usd"), F.col("p50_usd")).alias("p99_over_p50"),
            ratio(F.col("max_usd"), F.col("p99_usd")).alias("max_over_p99"),
        ),
    )
    return joined.withColumn(
        "purchases_without_revenue", F.col("purchase_sessions") - F.col("sessions_with_revenue")
    )


def revenue_gap(truth: DataFrame) -> DataFrame:
    """Hit-level minus session-level revenue, absolute and in % of the latter."""
    gap = F.col("hit_level_usd") - F.col("session_level_usd")
    return truth.select(
        "session_level_usd",
        "hit_level_usd",
        gap.alias("gap_usd"),
        (F.lit(100.0) * gap / F.nullif("session_level_usd", F.lit(0.0))).alias("gap_pct"),
    )


def reissue_summary(distribution: DataFrame, truth: DataFrame) -> DataFrame:
    """Transactions with no, one, several revenue hits; the gap per re-issued one."""
    k, n = F.col("rev_hits"), F.col("tx_count")
    counts = distribution.agg(
        F.sum("tx_count").alias("transactions"),
        F.sum(F.when(k == 0, n).otherwise(0)).alias("no_revenue_hit"),
        F.sum(F.when(k == 1, n).otherwise(0)).alias("one_revenue_hit"),
        F.sum(F.when(k > 1, n).otherwise(0)).alias("several_revenue_hits"),
    )
    both = side_by_side(counts, revenue_gap(truth).select("gap_usd"))
    return both.withColumns(
        {
            "pct_one": pct(F.col("one_revenue_hit"), F.col("transactions")),
            "pct_several": pct(F.col("several_revenue_hits"), F.col("transactions")),
            "gap_per_reissued_usd": ratio(F.col("gap_usd"), F.col("several_revenue_hits")),
            "with_revenue": F.col("transactions") - F.col("no_revenue_hit"),
        }
    )


def internal_split(internal: DataFrame, listed: Sequence[str] = LISTED_INTERNAL) -> DataFrame:
    """Listed internal sources against the rest and the total, with the biggest source of each."""
    part = F.when(F.col("source").isin(*listed), "listed").otherwise("rest")
    return (
        internal.select("*", F.explode(F.array(part, F.lit("all"))).alias("part"))
        .groupBy("part")
        .agg(
            F.count("*").alias("sources"),
            F.sum("sessions").alias("sessions"),
            F.sum("purchase_sessions").alias("purchase_sessions"),
            F.min_by("source", F.struct(-F.col("sessions"), F.col("source"))).alias("biggest_source"),
            F.max("sessions").alias("biggest_sessions"),
        )
        .withColumn("cr_pct", pct(F.col("purchase_sessions"), F.col("sessions")))
    )


def internal_share(sessions: DataFrame, listed: Sequence[str] = LISTED_INTERNAL) -> DataFrame:
    """Sessions of internal sources, listed and rest, as a share of all sessions; also those without any purchase."""
    part = F.when(F.col("source").isin(*listed), "listed").otherwise("rest")
    counted = sessions.groupBy(F.when(is_internal("source"), part).alias("part")).agg(
        F.count("*").alias("sessions"), F.sum("purchase_raw").cast("bigint").alias("purchases")
    )
    everything = F.sum("sessions").over(Window.partitionBy(F.lit(0)))
    shared = counted.withColumn("all_sessions", everything)
    return shared.where("part IS NOT NULL").withColumn("pct_of_all", pct(F.col("sessions"), F.col("all_sessions")))
