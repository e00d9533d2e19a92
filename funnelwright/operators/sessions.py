"""Row facts, hit facts and behavioural sessions.

Units, from fine to coarse:

* hit      - one page view or event;
* row      - one visit on one day, key (fullVisitorId, visitId, date);
* session  - one visit, key (fullVisitorId, visitId): rows cut at midnight are
  put together before any step is judged;
* visitor  - one browser cookie, fullVisitorId.

Nested session rows are flattened once, at the edge, into row facts (no
shuffle) and, where single hits matter, hit facts (`explode`). All later
operators take one of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import (
    ACTION_CODES,
    INTERNAL_SUFFIX,
    MIN_CELL,
    RAW_FLAGS,
    TOTAL_LABEL,
    flag,
    in_population,
    is_direct_sourced,
    is_hidden_direct,
    monotone_flags,
    strict_flags,
    visitor_type,
)

SESSION_KEY = ["fullVisitorId", "visitId"]
ROW_KEY = [*SESSION_KEY, "date"]


# ---- rows and hits ---------------------------------------------------------

def with_step_flags(nested: DataFrame, steps: dict[str, str] | None = None) -> DataFrame:
    """0/1 flag per step from the row's own hits array; no shuffle.

    Empty or NULL `hits`, and hits without an action, give 0. Only the action
    field is read: plain access through the array prunes the other hit fields,
    a lambda over whole hits would not.
    """
    steps = steps or dict(zip(RAW_FLAGS, ACTION_CODES))
    actions = F.col("hits.eCommerceAction.action_type")
    return nested.withColumns({name: flag(F.array_contains(actions, code)) for name, code in steps.items()})


def _first_page() -> Column:
    """(hitNumber, pagePath) of the row's first PAGE hit, NULL without one."""
    hits = F.arrays_zip("hits.hitNumber", "hits.page.pagePath", "hits.type")
    return F.array_min(F.filter(hits, lambda h: h["type"] == "PAGE"))


def with_landing_page(nested: DataFrame) -> DataFrame:
    """Path of the row's first PAGE hit by hit number; no shuffle."""
    return nested.withColumn("landing_page", _first_page()["pagePath"])


def row_facts(nested: DataFrame, in_place: bool = False) -> DataFrame:
    """Flat facts of each nested row: attributes, totals, step flags.

    Narrow for whole rows (`piece` NULL or absent), repeated keys included, and
    every field is reached by plain access, so that a query reads only the
    leaves it needs. The pieces of a row whose hits are stored in several are
    merged by its key with partial aggregation. Each of the two readings skips
    the row groups of the other by their null counts.

    With `in_place` both kinds of rows go through one aggregation, a whole row
    as a group of its own: for tables in buckets of visitors, which it reads as
    they lie, while a union of the two readings would have to be dealt anew.
    """
    hit_revenue = F.aggregate(
        F.col("hits.transaction.transactionRevenue"),
        F.lit(None).cast("bigint"),
        lambda total, r: F.coalesce(total + r, total, r),
    )
    flat = with_step_flags(nested).select(
        *ROW_KEY,
        "visitNumber",
        F.col("channelGrouping").alias("channel"),
        F.col("trafficSource.source").alias("source"),
        F.col("trafficSource.medium").alias("medium"),
        F.col("trafficSource.isTrueDirect").alias("is_true_direct"),
        F.col("trafficSource.referralPath").alias("referral_path"),
        F.col("device.deviceCategory").alias("device"),
        F.col("geoNetwork.country").alias("country"),
        F.col("geoNetwork.networkDomain").alias("net_domain"),
        F.col("totals.hits").alias("total_hits"),
        F.col("totals.pageviews").alias("pageviews"),
        F.col("totals.transactions").alias("transactions"),
        F.col("totals.transactionRevenue").alias("revenue"),
        F.col("totals.newVisits").alias("new_visits"),
        F.array_size("hits.hitNumber").cast("bigint").alias("n_hits"),
        *RAW_FLAGS,
        hit_revenue.alias("hit_revenue"),
        _first_page().alias("landing"),
        *(["piece"] if "piece" in nested.columns else []),
    )
    if "piece" not in nested.columns:
        return flat.withColumn("landing_page", F.col("landing.pagePath")).drop("landing")
    whole = flat.where("piece IS NULL").withColumn("landing_page", F.col("landing.pagePath")).drop("landing", "piece")
    merged = {
        **{name: F.max(name) for name in RAW_FLAGS},
        "n_hits": F.sum("n_hits"),
        "hit_revenue": F.sum("hit_revenue"),
    }
    same_on_every_piece = [c for c in flat.columns if c not in (*ROW_KEY, *merged, "piece", "landing")]
    aggregates = [
        *[F.min_by(c, F.coalesce("piece", F.lit(0))).alias(c) for c in same_on_every_piece],
        *[agg.alias(c) for c, agg in merged.items()],
        F.min("landing").pagePath.alias("landing_page"),
    ]
    if in_place:
        whole_row = F.when(F.col("piece").isNull(), F.monotonically_increasing_id())
        return flat.withColumn("whole_row", whole_row).groupBy(*ROW_KEY, "whole_row").agg(*aggregates).drop("whole_row")
    return whole.unionByName(flat.where("piece IS NOT NULL").groupBy(*ROW_KEY).agg(*aggregates))


HIT_LEAVES = {
    "hitNumber": "hits.hitNumber",
    "type": "hits.type",
    "page_path": "hits.page.pagePath",
    "action_type": "hits.eCommerceAction.action_type",
    "tx_id": "hits.transaction.transactionId",
    "tx_revenue": "hits.transaction.transactionRevenue",
}


def _zipped(columns: Sequence[str]) -> Column:
    """The wanted leaves of `hits`, side by side; only these are read."""
    return F.arrays_zip(*[HIT_LEAVES[c] for c in columns])


def _unzipped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    leaf = {c: HIT_LEAVES[c].rsplit(".", 1)[1] for c in columns}
    return df.select(*ROW_KEY, *[F.col("h")[leaf[c]].alias(c) for c in columns])


def hit_facts(nested: DataFrame, columns: Sequence[str] = tuple(HIT_LEAVES)) -> DataFrame:
    """One record per hit with the wanted hit columns. Rows with no hits drop out."""
    return _unzipped(nested.select(*ROW_KEY, F.explode(_zipped(columns)).alias("h")), columns)


def transaction_hits(nested: DataFrame, columns: Sequence[str] = ("tx_id", "tx_revenue")) -> DataFrame:
    """The hits that carry a transaction, picked inside the array before it is exploded."""
    bought = F.filter(_zipped(columns), lambda h: h["transactionId"].isNotNull())
    return _unzipped(nested.select(*ROW_KEY, F.explode(bought).alias("h")), columns)


def session_steps_exploded(hits: DataFrame) -> DataFrame:
    """Step flags per session from single hits; a session without hits is absent."""
    return hits.groupBy(*SESSION_KEY).agg(
        *[
            F.max(flag(F.col("action_type") == code)).alias(name)
            for name, code in zip(RAW_FLAGS, ACTION_CODES)
        ]
    )


# ---- sessions --------------------------------------------------------------

def normalise_origin(rows: DataFrame) -> DataFrame:
    """NULL source, medium and network become '' so that LIKE rules keep the row."""
    return rows.withColumns({c: F.expr(f"coalesce({c}, '')") for c in ("source", "medium", "net_domain")})


def behavioural_sessions(rows: DataFrame) -> DataFrame:
    """Rows of a visit put together; the one shuffle of every funnel.

    All attributes come from the earliest row of the visit (dates are unique
    within a visit), so the result does not depend on the order of rows. Each
    attribute is its own aggregate: those a query does not use are pruned and
    never shuffled.
    """
    rows = normalise_origin(rows)
    attributes = ["channel", "source", "medium", "referral_path", "device", "country", "net_domain", "new_visits"]
    return (
        rows.groupBy(*SESSION_KEY)
        .agg(
            F.min("date").alias("date"),
            *[F.min_by(c, "date").alias(c) for c in attributes],
            F.max("visitNumber").alias("visit_number"),
            F.expr("max(IF(is_true_direct, 1, 0))").alias("is_true_direct"),
            F.expr("max(IF(referral_path IS NOT NULL, 1, 0))").alias("has_referral_path"),
            F.sum("n_hits").alias("n_hits"),
            *[F.max(c).alias(c) for c in RAW_FLAGS],
            F.sum("revenue").alias("revenue"),
        )
    )


def population(sessions: DataFrame, internal_suffix: str = INTERNAL_SUFFIX) -> DataFrame:
    """Sessions with a known channel whose source is not internal.

    Judged on sessions, after the rows are put together.
    """
    return sessions.where(in_population("channel", "source", internal_suffix))


def with_monotone(df: DataFrame) -> DataFrame:
    return df.withColumns(monotone_flags(*RAW_FLAGS))


def with_strict(df: DataFrame) -> DataFrame:
    return df.withColumns(strict_flags(*RAW_FLAGS))


def with_direct_sourced(df: DataFrame) -> DataFrame:
    return df.withColumn("direct_sourced", flag(is_direct_sourced("source", "medium")))


def with_hidden_direct(df: DataFrame) -> DataFrame:
    """`grp`: 'hidden_direct' for Referral sessions with overwritten origin, else 'rest'."""
    return df.withColumn(
        "grp", F.when(is_hidden_direct("channel", "source", "medium"), "hidden_direct").otherwise("rest")
    )


def with_visitor_type(df: DataFrame) -> DataFrame:
    return df.withColumn("visitor_type", visitor_type("new_visits"))


# ---- variants, guards, totals ----------------------------------------------

def with_variants(df: DataFrame, variants: dict[str, Column], name: str = "variant") -> DataFrame:
    """Each row once per variant whose predicate keeps it; one scan, no join."""
    kept = F.array(*[F.when(predicate, F.lit(v)) for v, predicate in variants.items()])
    return df.select("*", F.explode(F.array_compact(kept)).alias(name))


def variant_counts(
    df: DataFrame, variants: dict[str, Column], keys: Sequence[str], counts: dict[str, Column], name: str = "variant"
) -> DataFrame:
    """Additive counts per variant and key, without multiplying the rows.

    Rows are first counted per set of variants that keep them - at most two to
    the number of variants sets - and only those counts are repeated.
    """
    kept = F.array_compact(F.array(*[F.when(predicate, F.lit(v)) for v, predicate in variants.items()]))
    per_set = df.withColumn("_kept", kept).groupBy("_kept", *keys).agg(*[c.alias(n) for n, c in counts.items()])
    return (
        per_set.select(F.explode("_kept").alias(name), *keys, *counts)
        .groupBy(name, *keys)
        .agg(*[F.sum(n).alias(n) for n in counts])
    )


def min_cell(
    df: DataFrame, count_col: str, minimum: int = MIN_CELL, mask: Sequence[str] | None = None
) -> DataFrame:
    """Drop cells under the minimum; with `mask`, keep them and NULL those columns."""
    enough = F.col(count_col) >= minimum
    if mask is None:
        return df.where(enough)
    return df.withColumns({c: F.when(enough, F.col(c)) for c in mask})


def rollup_total(
    df: DataFrame, group_col: str, counts: dict[str, Column], label: str = TOTAL_LABEL
) -> DataFrame:
    """Additive counts per group, plus a total line.

    Groups are counted first and the rollup runs on the counts, so the rows
    are not doubled. A NULL group stays NULL; only the total gets the label.
    """
    per_group = df.groupBy(group_col).agg(*[c.alias(n) for n, c in counts.items()])
    return (
        per_group.rollup(group_col)
        .agg(F.grouping(group_col).alias("_total"), *[F.sum(n).alias(n) for n in counts])
        .withColumn(group_col, F.when(F.col("_total") == 1, label).otherwise(F.col(group_col)))
        .drop("_total")
    )
