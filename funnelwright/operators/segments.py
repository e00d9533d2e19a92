"""Segments: channel by device, returning share, sample variants, countries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import INTERNAL_NETWORK, MIN_CELL, is_hidden_direct, is_unknown_channel, is_internal, pct
from .funnel import funnel_counts
from .metrics import gap, step_lines
from .sessions import min_cell, variant_counts, with_variants


def sample_variants() -> dict[str, Column]:
    """The four samples: all, without Social, without hidden Referral, without both."""
    social = F.col("channel") == "Social"
    hidden = is_hidden_direct("channel", "source", "medium")
    return {
        "all": F.lit(True),
        "no_social": ~social,
        "no_hidden_referral": ~hidden,
        "no_both": ~social & ~hidden,
    }


def sensitivity_variants() -> dict[str, Column]:
    """Samples of the sensitivity runs: hidden Referral and the internal network, each on its own."""
    return {
        "all": F.lit(True),
        "no_hidden_referral": ~is_hidden_direct("channel", "source", "medium"),
        "no_internal_network": F.col("net_domain") != INTERNAL_NETWORK,
    }


def channel_device_cross(P: DataFrame) -> DataFrame:
    """Channel by device: sessions, recorded views (strict), purchases, conversion."""
    return (
        P.groupBy("channel", "device")
        .agg(
            F.count("*").alias("sessions"),
            F.count_if(F.col("view_raw") == 1).alias("viewed_strict"),
            F.count_if(F.col("purchase_raw") == 1).alias("purchase_mono"),
        )
        .withColumn("cr_pct", pct(F.col("purchase_mono"), F.col("sessions")))
        .orderBy("channel", F.desc("sessions"), "device")
    )


def return_share(P: DataFrame) -> DataFrame:
    """Share of returning sessions (visit number above 1) per channel."""
    return (
        P.groupBy("channel")
        .agg(
            F.count("*").alias("sessions"),
            F.count_if(F.col("visit_number") > 1).alias("returning_sessions"),
        )
        .withColumn("pct_returning", pct(F.col("returning_sessions"), F.col("sessions")))
        .orderBy(F.desc("sessions"), "channel")
    )


def referral_two_ways(sessions: DataFrame) -> DataFrame:
    """The Referral funnel with internal subdomains and without them; takes all sessions."""
    referral = sessions.where(~is_unknown_channel("channel") & (F.col("channel") == "Referral"))
    variants = {"with_internal": F.lit(True), "without_internal": ~is_internal("source")}
    return variant_counts(referral, variants, [], funnel_counts()).orderBy("variant")


# ---- derived figures -------------------------------------------------------

def thin_steps(funnel: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Groups in which some step has too few sessions to be read."""
    steps = [c for c in funnel.columns if c.endswith(("_mono", "_strict"))]
    return funnel.where(F.least(*steps) < minimum)


def masked_cross(cross: DataFrame, devices: Sequence[str], minimum: int = MIN_CELL) -> DataFrame:
    """Conversion by channel and device; cells with too few purchases are NULL."""
    shown = min_cell(cross, "purchase_mono", minimum, mask=["cr_pct"])
    return shown.groupBy("channel").pivot("device", list(devices)).agg(F.first("cr_pct"))


def cross_cell_counts(cross: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """How many cells are under the minimum, and how many pass."""
    return cross.agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("purchase_mono") < minimum).alias("below"),
        F.count_if(F.col("purchase_mono") >= minimum).alias("pass"),
    )


def ranked_cells(cross: DataFrame, minimum: int = MIN_CELL) -> DataFrame:
    """Cells with enough purchases, by falling conversion."""
    return min_cell(cross, "purchase_mono", minimum).orderBy(F.desc("cr_pct"), "channel", "device")


def check_returning(P: DataFrame) -> DataFrame:
    """Two definitions of a returning session: visit number and `newVisits`."""
    return P.agg(
        F.count_if(F.col("visit_number") > 1).alias("by_visit_number"),
        F.count_if(F.coalesce(F.col("new_visits"), F.lit(0)) != 1).alias("by_new_visits"),
    ).withColumn("agree", F.col("by_visit_number") == F.col("by_new_visits"))


def cross_variants(cross: DataFrame, a: str = "desktop", b: str = "mobile") -> DataFrame:
    """Entry and conversion of two devices when whole channels are left out.

    Works on the cross table; `no_referral` leaves out all of Referral.
    """
    social, referral = F.col("channel") == "Social", F.col("channel") == "Referral"
    variants = {
        "all": F.lit(True), "no_social": ~social, "no_referral": ~referral, "no_both": ~social & ~referral,
    }
    sums = {
        f"{name}_{device}": F.sum(F.when(F.col("device") == device, F.col(c)))
        for device in (a, b)
        for name, c in (("sessions", "sessions"), ("viewed", "viewed_strict"), ("bought", "purchase_mono"))
    }
    wide = with_variants(cross, variants).groupBy("variant").agg(*[c.alias(n) for n, c in sums.items()])
    rates = {}
    for device in (a, b):
        rates[f"entry_{device}"] = pct(F.col(f"viewed_{device}"), F.col(f"sessions_{device}"))
        rates[f"cr_{device}"] = pct(F.col(f"bought_{device}"), F.col(f"sessions_{device}"))
    return wide.select(
        "variant",
        *[f"sessions_{d}" for d in (a, b)],
        *[c.alias(n) for n, c in rates.items()],
        (rates[f"entry_{a}"] - rates[f"entry_{b}"]).alias("entry_gap_pp"),
        (rates[f"cr_{a}"] / F.nullif(rates[f"cr_{b}"], F.lit(0.0))).alias("cr_ratio"),
    )


def variant_removed(by_variant: DataFrame, device: str = "desktop", base: str = "all") -> DataFrame:
    """Sessions each sample variant leaves out, and the share of one device in them."""
    of_device = F.col("device") == device
    sums = by_variant.groupBy("variant").agg(
        F.sum("sessions").alias("n"), F.sum(F.when(of_device, F.col("sessions")).otherwise(0)).alias("n_device")
    )
    every_variant = Window.partitionBy(F.lit(0))
    whole = {c: F.max(F.when(F.col("variant") == base, F.col(c))).over(every_variant) for c in ("n", "n_device")}
    removed, removed_device = F.col("removed"), F.col("removed_device")
    return (
        sums.select(
            "variant",
            (whole["n"] - F.col("n")).alias("removed"),
            (whole["n_device"] - F.col("n_device")).alias("removed_device"),
        )
        .where(F.col("variant") != base)
        .withColumn("pct_device", pct(removed_device, removed))
    )


def variant_gaps(by_variant: DataFrame, a: str = "desktop", b: str = "mobile") -> DataFrame:
    """Gap of two devices per step in each variant and version, and last minus first."""
    long = step_lines(by_variant.where(F.col("device").isin(a, b)), "device", by=["variant"])
    steps = gap(long, "device", a, b, by=["variant"])
    return (
        steps.groupBy("variant", "version")
        .pivot("step", ["viewed", "cart", "checkout", "purchase"])
        .agg(F.first("gap_pp"))
        .withColumn("last_minus_first", F.col("purchase") - F.col("viewed"))
    )


