"""Funnels by group, the monotone confound, channel composition, exclusions.

`P` in the signatures is the population: behavioural sessions after the filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import top_k_per_group
from ..functions.rules import RAW_FLAGS, STEPS, is_internal, is_unknown_channel, monotone_flags, pct, strict_flags
from .sessions import rollup_total, variant_counts

VERSIONS = ("mono", "strict")


def funnel_counts(versions: Sequence[str] = VERSIONS) -> dict[str, Column]:
    """Sessions and sessions at each step, as aggregates over raw flags."""
    flags = {}
    if "mono" in versions:
        flags |= monotone_flags(*RAW_FLAGS)
    if "strict" in versions:
        flags |= strict_flags(*RAW_FLAGS)
    return {"sessions": F.count("*"), **{name: F.count_if(f == 1) for name, f in flags.items()}}


def funnel_by(P: DataFrame, group_col: str, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """Five-level funnel per group, with a total line."""
    return rollup_total(P, group_col, funnel_counts(versions)).orderBy(F.desc("sessions"), group_col)


def funnel_by_variants(P: DataFrame, group_col: str, variants: dict[str, Column]) -> DataFrame:
    """Funnel per group and sample variant, from one scan."""
    counted = variant_counts(P, variants, [group_col], funnel_counts())
    return counted.orderBy("variant", F.desc("sessions"), group_col)


def funnel_top_groups(P: DataFrame, group_col: str, n: int = 5) -> DataFrame:
    """Monotone funnel of the `n` biggest groups; the NULL group never qualifies.

    The biggest groups are chosen on the funnel itself, so the sessions are
    read once. A NULL group takes its place in the ranking but is not shown.
    """
    per_group = P.groupBy(group_col).agg(*[c.alias(k) for k, c in funnel_counts(["mono"]).items()])
    order = [F.desc("sessions"), F.asc_nulls_first(group_col)]
    return per_group.orderBy(*order).limit(n).where(F.col(group_col).isNotNull()).orderBy(*order)


def monotone_confound(P: DataFrame, group_col: str) -> DataFrame:
    """How often the view step is missing: over sessions with hits, and over buyers."""
    hits, view, purchase = F.col("n_hits") > 0, F.col("view_raw"), F.col("purchase_raw")
    counts = {
        "sessions_with_hits": F.count_if(hits),
        "no_view_event": F.count_if(hits & (view == 0)),
        "purchase_sessions": F.count_if(purchase == 1),
        "buyers_no_view": F.count_if((purchase == 1) & (view == 0)),
    }
    return (
        rollup_total(P, group_col, counts)
        .withColumns(
            {
                "pct_no_view": pct(F.col("no_view_event"), F.col("sessions_with_hits")),
                "pct_buyers_no_view": pct(F.col("buyers_no_view"), F.col("purchase_sessions")),
            }
        )
        .orderBy(F.desc("sessions_with_hits"), group_col)
    )


def channel_composition(P: DataFrame, n: int = 5) -> DataFrame:
    """Top `n` (source, medium) per channel and their share of the channel.

    Channel totals are their own aggregate of the counts, so the origins of a
    channel are never brought together in one task.
    """
    counted = P.groupBy("channel", "source", "medium").agg(F.count("*").alias("sessions"))
    whole = counted.groupBy("channel").agg(F.sum("sessions").alias("whole"))
    top = top_k_per_group(counted, "channel", [F.desc("sessions"), F.col("source"), F.col("medium")], n)
    return (
        top.join(whole, "channel")
        .withColumn("pct_of_channel", pct(F.col("sessions"), F.col("whole")))
        .drop("whole")
        .orderBy("channel", F.desc("sessions"), "source", "medium")
    )


def channel_concentration(P: DataFrame) -> DataFrame:
    """Per channel: sessions, distinct sources, the top source and its share."""
    per_source = P.groupBy("channel", "source").agg(F.count("*").alias("n"))
    return (
        per_source.groupBy("channel")
        .agg(
            F.sum("n").alias("sessions"),
            F.count("*").alias("distinct_sources"),
            F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("top_source"),
            F.max("n").alias("top_n"),
        )
        .withColumn("top_source_pct", pct(F.col("top_n"), F.col("sessions")))
        .drop("top_n")
        .orderBy(F.desc("sessions"), "channel")
    )


def internal_medium(rows: DataFrame) -> DataFrame:
    """Internal rows by medium: does the exclusion rule cut more than referrals. Counts rows."""
    return (
        rows.where(is_internal("source"))
        .groupBy("medium")
        .agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), "medium")
    )


def exclusions_reconciliation(sessions: DataFrame) -> DataFrame:
    """Sessions before and after each exclusion; takes all sessions."""
    unknown, internal = is_unknown_channel("channel"), is_internal("source")
    return sessions.agg(
        F.count("*").alias("sessions_all"),
        F.count_if(unknown).alias("excl_no_channel"),
        F.count_if(internal).alias("excl_internal_google"),
        F.count_if(unknown & internal).alias("excl_overlap"),
        F.count_if(~unknown & ~internal).alias("sessions_kept"),
    )


def reached_step_names(version: str) -> list[str]:
    return [f"{s}_{version}" for s in STEPS]
