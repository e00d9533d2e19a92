"""Tests and effect sizes on funnel tables, revenue by group, variation.

A cell is tested on a step only when enough sessions enter that step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import MIN_CELL, STEPS, TOTAL_LABEL, pct, ratio, usd
from ..functions.special import chi_square_tail
from .sessions import variant_counts


def testable_cells(long: DataFrame, group_col: str, minimum: int = MIN_CELL) -> DataFrame:
    """Groups and steps with enough sessions entering the step; the total line is left out."""
    total = F.coalesce(F.col(group_col) == TOTAL_LABEL, F.lit(False))
    return long.where(~total).withColumn("tested", F.col("prev_n") >= minimum)


def chi_square_counts(cells: DataFrame, keys: Sequence[str], entered: str, passed: str) -> DataFrame:
    """Chi-square of group against passing, per `keys`; one line per group comes in.

    Both outcomes of a group deviate by the same amount, so its two cells add
    to (passed - entered * p)^2 / (entered * p * (1 - p)).
    """
    same = Window.partitionBy(*keys)
    n, k = F.col(entered), F.col(passed)
    p = F.sum(k).over(same) / F.nullif(F.sum(n).over(same), F.lit(0))
    part = F.pow(k - n * F.col("_p"), F.lit(2.0)) / F.nullif(n * F.col("_p") * (1 - F.col("_p")), F.lit(0.0))
    return (
        cells.withColumn("_p", p)
        .groupBy(*keys)
        .agg(F.count("*").alias("groups"), F.sum(n).alias("n"), F.sum(part).alias("chi2"))
        .withColumn("df", F.col("groups") - 1)
        .withColumn(
            "cramers_v",
            F.when(F.col("df") >= 1, F.sqrt(F.col("chi2") / F.nullif(F.col("n"), F.lit(0)))),
        )
    )


def chi_square(
    long: DataFrame, group_col: str, minimum: int = MIN_CELL, by: Sequence[str] = ()
) -> DataFrame:
    """Chi-square of group against passing the step, per step: statistic, effect size, p, Holm p.

    The table has two columns (passed, not), so Cramer's V is sqrt(chi2 / n).
    """
    cells = testable_cells(long, group_col, minimum).where("tested")
    tests = chi_square_counts(cells, [*by, "version", "step", "step_no"], "prev_n", "n")
    tests = tests.withColumn(
        "p_value", F.when(F.col("df") >= 1, chi_square_tail(F.col("chi2"), F.col("df").cast("int")))
    )
    return holm(tests, "p_value", [*by, "version"], ["step_no"])


def cramers_v(long: DataFrame, group_col: str, minimum: int = MIN_CELL, by: Sequence[str] = ()) -> DataFrame:
    """Effect size alone."""
    return chi_square(long, group_col, minimum, by).select(*by, "version", "step", "cramers_v")


def through_conversion(long: DataFrame, group_col: str, minimum: int = MIN_CELL, by: Sequence[str] = ()) -> DataFrame:
    """Group against purchase from the start of the session, not from the step before: statistic, effect size, p."""
    last = testable_cells(long.where(F.col("step") == STEPS[-1]).withColumn("prev_n", F.col("sessions")), group_col, minimum)
    tests = chi_square_counts(last.where("tested"), [*by, "version"], "sessions", "n")
    return tests.withColumn("p_value", F.when(F.col("df") >= 1, chi_square_tail(F.col("chi2"), F.col("df").cast("int"))))


def holm(tests: DataFrame, p_value: str, family: Sequence[str], order: Sequence[str], level: float = 0.05) -> DataFrame:
    """Holm-adjusted p within each family of tests; `order` breaks ties of p."""
    p = F.col(p_value)
    fam = Window.partitionBy(*family)
    ranked = fam.orderBy(F.asc_nulls_last(p_value), *order)
    left = F.count(p).over(fam) - F.row_number().over(ranked) + 1
    running = F.max("_scaled").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return (
        tests.withColumn("_scaled", F.when(p.isNotNull(), p * left))
        .withColumn("p_holm", F.when(p.isNotNull(), F.least(F.lit(1.0), running)))
        .withColumn("significant", F.col("p_holm") < level)
        .drop("_scaled")
    )


def z_test(
    long: DataFrame, group_col: str, a: str, b: str, minimum: int = MIN_CELL, by: Sequence[str] = ()
) -> DataFrame:
    """Two-proportion z-test of `a` against `b` per step, with Holm p.

    z squared is the 2x2 chi-square, so p is its tail with one degree of freedom.
    """
    cells = testable_cells(long, group_col, minimum).where(F.col("tested") & F.col(group_col).isin(a, b))

    def of(group: str, c: str) -> Column:
        return F.sum(F.when(F.col(group_col) == group, F.col(c)))

    pair = cells.groupBy(*by, "version", "step", "step_no").agg(
        of(a, "prev_n").alias("n_a"), of(a, "n").alias("k_a"), of(b, "prev_n").alias("n_b"), of(b, "n").alias("k_b")
    )
    n_a, k_a, n_b, k_b = (F.col(c) for c in ("n_a", "k_a", "n_b", "k_b"))
    pooled = ratio(k_a + k_b, n_a + n_b)
    error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    tests = pair.withColumn("z", (ratio(k_a, n_a) - ratio(k_b, n_b)) / F.nullif(error, F.lit(0.0))).withColumn(
        "p_value", chi_square_tail(F.col("z") * F.col("z"), F.lit(1))
    )
    return holm(tests, "p_value", [*by, "version"], ["step_no"])


# ---- revenue ---------------------------------------------------------------

def revenue_by(P: DataFrame, group: str, variants: dict[str, Column] | None = None) -> DataFrame:
    """Average order value (purchase sessions with revenue) and revenue per session.

    NULL revenue never becomes 0 in the average. With `variants`, one line per
    sample variant and group.
    """
    rev, purchase = F.col("revenue"), F.col("purchase_raw") == 1
    bought = F.when(purchase, rev)
    sums = {
        "sessions": F.count("*"),
        "purchase_sessions": F.count_if(purchase),
        "sessions_with_revenue": F.count(rev),
        "revenue": F.sum(rev),
        "orders": F.count(bought),
        "order_revenue": F.sum(bought),
    }
    if variants:
        counted, keys = variant_counts(P, variants, [group], sums), ["variant", group]
    else:
        counted, keys = P.groupBy(group).agg(*[c.alias(n) for n, c in sums.items()]), [group]
    return counted.select(
        *keys,
        "sessions",
        "purchase_sessions",
        "sessions_with_revenue",
        usd(F.col("revenue")).alias("revenue_usd"),
        (usd(F.col("order_revenue")) / F.nullif("orders", F.lit(0))).alias("avg_order_usd"),
        (usd(F.col("revenue")) / F.col("sessions")).alias("revenue_per_session_usd"),
    )


def cv_compare(
    P: DataFrame, group: str = "channel", variants: dict[str, Column] | None = None, factor: float = 2.0
) -> DataFrame:
    """Variation of conversion against variation of order value over the groups.

    Population standard deviation over the mean. Confirmed when the first is at
    least `factor` times the second; the factor is a convention.
    """
    per_group = revenue_by(P, group, variants).withColumn(
        "conversion_pct", pct(F.col("purchase_sessions"), F.col("sessions"))
    )

    def cv(c: str) -> Column:
        return F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0))

    return (
        per_group.groupBy(*(["variant"] if variants else []))
        .agg(
            F.count("*").alias("groups"),
            cv("conversion_pct").alias("cv_conversion"),
            cv("avg_order_usd").alias("cv_order_value"),
        )
        .withColumns(
            {
                "cv_ratio": F.col("cv_conversion") / F.nullif("cv_order_value", F.lit(0.0)),
                "confirmed": F.col("cv_conversion") >= factor * F.col("cv_order_value"),
            }
        )
    )
