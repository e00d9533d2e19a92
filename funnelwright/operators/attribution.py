"""Traffic whose origin was overwritten: where it sits, what it is, who brings it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import top_k_per_group
from ..functions.rules import MIN_CELL, flag, is_direct_sourced, is_hidden_direct, pct, ratio
from .sessions import with_direct_sourced, with_hidden_direct


def direct_source_vs_channel(P: DataFrame) -> DataFrame:
    """Per channel: direct-sourced share, return rates inside and outside it, its signals."""
    direct, back = F.col("direct_sourced") == 1, F.col("visit_number") > 1
    counted = (
        with_direct_sourced(P)
        .groupBy("channel")
        .agg(
            F.count("*").alias("sessions"),
            F.count_if(direct).alias("direct_sourced"),
            F.count_if(direct & back).alias("direct_back"),
            F.count_if(~direct & back).alias("rest_back"),
            F.count_if(direct & (F.col("is_true_direct") == 1)).alias("direct_true"),
            F.count_if(direct & (F.col("has_referral_path") == 1)).alias("direct_path"),
        )
    )
    n_direct = F.col("direct_sourced")
    return counted.select(
        "channel",
        "sessions",
        "direct_sourced",
        pct(n_direct, F.col("sessions")).alias("pct_direct_sourced"),
        pct(F.col("direct_back"), n_direct).alias("pct_return_direct"),
        pct(F.col("rest_back"), F.col("sessions") - n_direct).alias("pct_return_rest"),
        pct(F.col("direct_true"), n_direct).alias("pct_true_direct"),
        pct(F.col("direct_path"), n_direct).alias("pct_referral_path"),
    ).orderBy(F.desc("direct_sourced"), "channel")


def funnel_by_direct_sourced(P: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Channel by origin bucket; cells with enough sessions.

    `viewed_or_purchased` credits the view only to buyers, so it is below the
    full monotone view count.
    """
    bucket = F.when(is_direct_sourced("source", "medium"), "hidden_direct").otherwise("raw_source")
    return (
        P.withColumn("bucket", bucket)
        .groupBy("channel", "bucket")
        .agg(
            F.count("*").alias("sessions"),
            F.count_if(F.greatest("view_raw", "purchase_raw") == 1).alias("viewed_or_purchased"),
            F.count_if(F.col("purchase_raw") == 1).alias("purchases"),
        )
        .where(F.col("sessions") >= minimum)
        .withColumn("cr_pct", pct(F.col("purchases"), F.col("sessions")))
        .orderBy("channel", "bucket")
    )


def hidden_direct_paths(sessions: DataFrame, n: int = 30) -> DataFrame:
    """Hidden-direct sessions by referral path, top `n`; takes all sessions."""
    return (
        sessions.where(is_hidden_direct("channel", "source", "medium"))
        .groupBy("referral_path")
        .agg(
            F.count("*").alias("sessions"),
            F.count_if(F.col("purchase_raw") == 1).alias("purchases"),
            F.count_if(F.col("visit_number") > 1).alias("back"),
        )
        .select(
            "referral_path",
            "sessions",
            "purchases",
            pct(F.col("purchases"), F.col("sessions")).alias("cr_pct"),
            pct(F.col("back"), F.col("sessions")).alias("pct_returning"),
        )
        .orderBy(F.desc("sessions"), "referral_path")
        .limit(n)
    )


def hidden_direct_landing(rows: DataFrame, n: int = 20) -> DataFrame:
    """Hidden-direct rows by landing page, top `n`. Counts rows."""
    return (
        rows.where(is_hidden_direct("channel", "source", "medium"))
        .groupBy("landing_page")
        .agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), "landing_page")
        .limit(n)
    )


def hidden_direct_network(P: DataFrame, n: int = 15) -> DataFrame:
    """Top `n` network domains among hidden-direct sessions and among the rest."""
    counted = (
        with_hidden_direct(P)
        .groupBy("grp", "net_domain")
        .agg(F.count("*").alias("sessions"), F.count_if(F.col("purchase_raw") == 1).alias("purchases"))
        .withColumn("cr_pct", pct(F.col("purchases"), F.col("sessions")))
    )
    top = top_k_per_group(counted, "grp", [F.desc("sessions"), F.col("net_domain")], n)
    return top.orderBy("grp", F.desc("sessions"), "net_domain")


def hidden_direct_concentration(P: DataFrame) -> DataFrame:
    """Do a few visitors bring the purchases. A visitor counts once in each group."""
    per_visitor = (
        with_hidden_direct(P)
        .groupBy("fullVisitorId", "grp")
        .agg(F.count("*").alias("n"), F.count_if(F.col("purchase_raw") == 1).alias("bought"))
    )
    return (
        per_visitor.groupBy("grp")
        .agg(
            F.count("*").alias("visitors"),
            F.sum("n").alias("sessions"),
            F.sum("bought").alias("purchases"),
            F.count_if(F.col("bought") >= 1).alias("buyers"),
            F.count_if(F.col("bought") >= 3).alias("buyers_3plus"),
            F.sum(F.when(F.col("bought") >= 3, F.col("bought")).otherwise(0)).alias("from_3plus"),
        )
        .withColumns(
            {
                "sessions_per_visitor": ratio(F.col("sessions"), F.col("visitors")),
                "pct_purchases_from_3plus": pct(F.col("from_3plus"), F.col("purchases")),
            }
        )
        .drop("from_3plus")
    )


# ---- derived figures -------------------------------------------------------

def direct_reassigned(P: DataFrame) -> DataFrame:
    """Direct-sourced sessions that stayed in Direct, and those credited elsewhere."""
    direct = flag(is_direct_sourced("source", "medium")) == 1
    return P.agg(
        F.count("*").alias("sample"),
        F.count_if(direct).alias("direct_sourced"),
        F.count_if(direct & (F.col("channel") == "Direct")).alias("in_direct"),
        F.count_if(direct & (F.col("channel") != "Direct")).alias("reassigned"),
    ).withColumns(
        {
            "pct_in_direct": pct(F.col("in_direct"), F.col("direct_sourced")),
            "pct_reassigned": pct(F.col("reassigned"), F.col("direct_sourced")),
            "pct_reassigned_of_sample": pct(F.col("reassigned"), F.col("sample")),
        }
    )


def origin_matrix(by_origin: DataFrame) -> DataFrame:
    """Conversion by channel (lines) and origin bucket (columns)."""
    return by_origin.groupBy("channel").pivot("bucket", ["hidden_direct", "raw_source"]).agg(F.first("cr_pct"))


def path_share(sessions: DataFrame, path: str = "/") -> DataFrame:
    """Share of one referral path among the hidden-direct sessions."""
    hidden = sessions.where(is_hidden_direct("channel", "source", "medium"))
    return hidden.agg(
        F.count_if(F.col("referral_path") == path).alias("path_sessions"), F.count("*").alias("bucket_sessions")
    ).withColumn("pct_of_bucket", pct(F.col("path_sessions"), F.col("bucket_sessions")))


def domain_share(P: DataFrame, domain: str = "(not set)") -> DataFrame:
    """Share of one network domain among hidden-direct sessions and among the rest."""
    return (
        with_hidden_direct(P)
        .groupBy("grp")
        .agg(
            F.count_if(F.col("net_domain") == domain).alias("domain_sessions"),
            F.count("*").alias("sessions"),
        )
        .withColumn("pct_of_group", pct(F.col("domain_sessions"), F.col("sessions")))
    )
