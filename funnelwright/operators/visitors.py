"""Visitor level: first touch against last click, edges of the time window.

Everything about a visitor is one aggregate of its sessions; no window and no
join runs over a visitor's sessions, so a very busy visitor is reduced on the
map side like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import exact_percentiles
from ..functions.rules import flag, pct
from ..sources.tables import stored
from .sessions import with_variants


def visitor_profiles(P: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One line per visitor: first session, volume, purchases by session channel.

    `by_channel` holds one entry per channel the visitor used, so its length is
    bounded by the number of channels. The first session is the one with the
    lowest (visitNumber, visitId).
    """
    bought = F.col("purchase_raw") == 1
    per_channel = P.groupBy(*by, "fullVisitorId", "channel").agg(
        F.count("*").alias("n"),
        F.count_if(bought).alias("purchases"),
        F.min(F.struct("visit_number", "visitId", "date", "channel")).alias("first"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min(F.when(bought, F.col("date"))).alias("first_purchase"),
    )
    return per_channel.groupBy(*by, "fullVisitorId").agg(
        F.sum("n").alias("sessions"),
        F.sum("purchases").alias("purchases"),
        F.min("first").alias("first"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.min("first_purchase").alias("first_purchase"),
        F.collect_list(F.struct("channel", "purchases")).alias("by_channel"),
    )


def first_touch(visitors: DataFrame) -> DataFrame:
    """First-touch channel per visitor, with its sessions and purchases."""
    return visitors.select(
        "fullVisitorId",
        F.col("first.channel").alias("first_channel"),
        F.col("first.visit_number").alias("first_visit_number"),
        "first_date",
        "sessions",
        "purchases",
    )


def purchase_credits(visitors: DataFrame) -> DataFrame:
    """Buyers with their purchases credited by both rules, as a short sorted array.

    Entries are (channel, last, first); at most one per channel used, plus one.
    """
    none = F.lit(0).cast("bigint")
    last = F.transform(
        F.filter("by_channel", lambda c: c["purchases"] > 0),
        lambda c: F.struct(c["channel"].alias("channel"), c["purchases"].alias("last"), none.alias("first")),
    )
    first = F.struct(F.col("first.channel").alias("channel"), none.alias("last"), F.col("purchases").alias("first"))
    return visitors.where(F.col("purchases") > 0).withColumn(
        "credits", F.array_sort(F.concat(last, F.array(first)))
    )


def attribution_shift(visitors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Channels ranked by purchases, credited to the session's channel and to first touch.

    A positive shift means the channel gains places under first touch. Ranks
    share the best place on ties. Channels with no purchase under either rule
    are left out.
    """
    places = {
        name: F.rank().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(name))).cast("bigint")
        for name in ("last_click", "first_touch")
    }
    credited = (
        purchase_credits(visitors)
        .select(*by, F.explode("credits").alias("c"))
        .groupBy(*by, F.col("c.channel").alias("channel"))
        .agg(F.sum("c.last").alias("last_click"), F.sum("c.first").alias("first_touch"))
    )
    return credited.select(
        *by,
        "channel",
        "last_click",
        "first_touch",
        places["last_click"].alias("last_click_rank"),
        places["first_touch"].alias("first_touch_rank"),
        (places["last_click"] - places["first_touch"]).alias("shift"),
    )


def _mean_rank(c: str, keys: Sequence[str | Column]) -> Column:
    """Rank with ties averaged."""
    ordered = Window.partitionBy(*keys).orderBy(F.desc(c))
    same = Window.partitionBy(*keys, c)
    return F.rank().over(ordered) + (F.count("*").over(same) - 1) / F.lit(2.0)


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of two columns of a small table, ties averaged."""
    keys = list(by) or [F.lit(0)]
    ranked = df.select(*by, _mean_rank(a, keys).alias("ra"), _mean_rank(b, keys).alias("rb"))
    ra, rb = F.col("ra"), F.col("rb")
    n = F.count("*")
    cov = F.sum(ra * rb) - F.sum(ra) * F.sum(rb) / n
    var = (F.sum(ra * ra) - F.sum(ra) * F.sum(ra) / n) * (F.sum(rb * rb) - F.sum(rb) * F.sum(rb) / n)
    return ranked.groupBy(*by).agg(n.alias("n"), (cov / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("rho"))


def attribution_verdict(shifts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest shift and whether any channel moves by two places or more."""
    return shifts.groupBy(*by).agg(
        F.count("*").alias("channels"),
        F.max(F.abs("shift")).alias("largest_shift"),
        F.min_by("channel", F.struct(-F.abs("shift"), F.col("channel"))).alias("largest_channel"),
        (F.max(F.abs("shift")) >= 2).alias("confirmed"),
    )


def purchase_visit_numbers(P: DataFrame) -> DataFrame:
    """Distribution of the visit number over purchase sessions."""
    counted = P.where(F.col("purchase_raw") == 1).groupBy("visit_number").agg(F.count("*").alias("purchases"))
    return counted.orderBy("visit_number")


def visits_to_purchase(P: DataFrame, visitors: DataFrame) -> DataFrame:
    """Median visit number of purchase sessions by first-touch channel.

    Purchases are counted per (visitor, visit number) before they meet the
    visitor's first channel, and per (channel, visit number) before the median,
    which is then weighted by the counts. Only buyers enter the join.
    """
    bought = (
        P.where(F.col("purchase_raw") == 1)
        .groupBy("fullVisitorId", "visit_number")
        .agg(F.count("*").alias("n"))
    )
    channel = visitors.where(F.col("purchases") > 0).select(
        "fullVisitorId", F.col("first.channel").alias("first_channel")
    )
    counted = bought.join(channel, "fullVisitorId").groupBy("first_channel", "visit_number").agg(F.sum("n").alias("n"))
    return counted.groupBy("first_channel").agg(
        F.sum("n").alias("purchases"), F.percentile("visit_number", 0.5, F.col("n")).alias("median_visits")
    )


def _with_observed(visitors: DataFrame, percent: int) -> DataFrame:
    """Visitors with the horizon, the last day of the window, and whether they are kept.

    Horizon: nearest-rank percentile, over buyers, of the days from the first
    session to the first purchase. The visitors are stored first: they are
    derived once, and the two figures come from the stored table.
    """
    visitors = stored(visitors, "visitors")
    to_purchase = visitors.select(F.date_diff("first_purchase", "first_date").alias("days"))
    horizon = exact_percentiles(to_purchase, "days", {"horizon_days": percent}).first()["horizon_days"]
    end = visitors.agg(F.max("last_date")).first()[0]
    known = {"horizon_days": F.lit(horizon).cast("int"), "window_end": F.lit(end).cast("string")}
    return visitors.withColumns(known).withColumn(
        "observed", flag(F.date_diff("window_end", "first_date") >= F.col("horizon_days"))
    )


def observable_visitors(visitors: DataFrame, percent: int = 90) -> DataFrame:
    """Right edge: visitors whose first session leaves at least the horizon to come back."""
    seen = _with_observed(visitors, percent)
    return seen.where(F.col("observed") == 1).select(*visitors.columns)


def right_edge(visitors: DataFrame, percent: int = 90) -> DataFrame:
    """The horizon taken from the data, and how many visitors it drops."""
    kept = F.sum("observed")
    return _with_observed(visitors, percent).agg(
        F.max("horizon_days").cast("bigint").alias("horizon_days"),
        F.max("window_end").alias("window_end"),
        F.count("*").alias("visitors"),
        kept.alias("kept"),
        (F.count("*") - kept).alias("dropped"),
    )


def first_seen(sessions: DataFrame) -> DataFrame:
    """Index of visitors: the first session of each in the window, over all sessions.

    To be built before the population filter: a session that the analysis leaves out still shows that the visitor's
    history begins inside the window. Kept beside the session table, one line per visitor, and extended by day.
    """
    return sessions.groupBy("fullVisitorId").agg(F.min(F.struct("visit_number", "visitId", "date")).alias("first_seen"))


def extend_first_seen(index: DataFrame, sessions: DataFrame) -> DataFrame:
    """The index with the sessions of further days, in any order; only these are read."""
    both = index.unionByName(first_seen(sessions))
    return both.groupBy("fullVisitorId").agg(F.min("first_seen").alias("first_seen"))


def with_first_seen(visitors: DataFrame, index: DataFrame) -> DataFrame:
    """Visitors with `truncated`: 1 if the first session in the window is not the first ever."""
    known = index.select("fullVisitorId", flag(F.col("first_seen.visit_number") > 1).alias("truncated"))
    return visitors.join(known, "fullVisitorId", "left")


def left_truncated(visitors: DataFrame, index: DataFrame) -> DataFrame:
    """Left edge: visitors whose first session in the window is not their first ever."""
    return with_first_seen(visitors, index).agg(
        F.count("*").alias("visitors"), F.count_if(F.col("truncated") == 1).alias("truncated")
    ).withColumn("pct_truncated", pct(F.col("truncated"), F.col("visitors")))


def untruncated(visitors: DataFrame, index: DataFrame) -> DataFrame:
    """Visitors whose first session in the window is really the first."""
    return with_first_seen(visitors, index).where(F.col("truncated") == 0).drop("truncated")


def multi_session(visitors: DataFrame, minimum: int = 2) -> DataFrame:
    """Visitors with at least two sessions."""
    return visitors.where(F.col("sessions") >= minimum)


def with_slices(visitors: DataFrame, index: DataFrame, percent: int = 90) -> DataFrame:
    """Each visitor once per slice (`slice`) it belongs to: all, and the three guards above."""
    slices = {
        "all": F.lit(True),
        "observable": F.col("observed") == 1,
        "untruncated": F.col("truncated") == 0,
        "multi_session": F.col("sessions") >= 2,
    }
    known = with_first_seen(_with_observed(visitors, percent), index)
    return with_variants(known, slices, "slice").drop("horizon_days", "window_end", "observed", "truncated")
