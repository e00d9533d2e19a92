"""The analysis rules, each as one Column expression.

Nothing here shuffles; every rule stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Funnel steps in order, and the e-commerce action code of each.
STEPS = ("viewed", "cart", "checkout", "purchase")
RAW_FLAGS = ("view_raw", "cart_raw", "checkout_raw", "purchase_raw")
ACTION_CODES = ("2", "3", "5", "6")

# Labels used by the rules.
OTHER_CHANNEL = "(Other)"
DIRECT_SOURCE = "(direct)"
NO_MEDIUM = "(none)"
INTERNAL_SUFFIX = ".google.com"
INTERNAL_NETWORK = "google.com"
TOTAL_LABEL = "ALL"
MIN_CELL = 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """0/1 integer; NULL counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_unknown_channel(channel: Column | str) -> Column:
    channel = _col(channel)
    return channel.isNull() | (channel == OTHER_CHANNEL)


def is_internal(source: Column | str, suffix: str = INTERNAL_SUFFIX) -> Column:
    """Source is a subdomain of the shop owner; the bare domain is not."""
    return _col(source).endswith(suffix)


def in_population(channel: Column | str, source: Column | str, suffix: str = INTERNAL_SUFFIX) -> Column:
    """Session belongs to the analysed population. A NULL source is kept."""
    return ~is_unknown_channel(channel) & ~is_internal(F.coalesce(_col(source), F.lit("")), suffix)


def is_direct_sourced(source: Column | str, medium: Column | str) -> Column:
    return F.coalesce((_col(source) == DIRECT_SOURCE) & (_col(medium) == NO_MEDIUM), F.lit(False))


def is_hidden_direct(channel: Column | str, source: Column | str, medium: Column | str) -> Column:
    """Referral session whose origin was overwritten with direct / none."""
    return F.coalesce(_col(channel) == "Referral", F.lit(False)) & is_direct_sourced(source, medium)


def visitor_type(new_visits: Column | str) -> Column:
    """`newVisits` is 1 or NULL, never 0, so NULL means returning."""
    return F.when(F.coalesce(_col(new_visits), F.lit(0)) == 1, "new").otherwise("returning")


def monotone_flags(view: str, cart: str, checkout: str, purchase: str) -> dict[str, Column]:
    """Reaching a step credits every earlier step."""
    raw = [F.col(c) for c in (view, cart, checkout, purchase)]
    return {
        f"{step}_mono": (F.greatest(*raw[i:]) if i < 3 else raw[3])
        for i, step in enumerate(STEPS)
    }


def strict_flags(view: str, cart: str, checkout: str, purchase: str) -> dict[str, Column]:
    """A step counts only if every earlier event was recorded too."""
    raw = [F.col(c) for c in (view, cart, checkout, purchase)]
    return {f"{step}_strict": F.least(*raw[: i + 1]) if i else raw[0] for i, step in enumerate(STEPS)}


def ratio(num: Column, den: Column) -> Column:
    """Unrounded double; NULL when the denominator is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def pct(num: Column, den: Column) -> Column:
    return F.lit(100.0) * num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def usd(micro: Column) -> Column:
    """Micro-units to dollars."""
    return micro.cast("double") / F.lit(1e6)
