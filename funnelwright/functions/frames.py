"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row frames with different columns, as one row. A union, not a cross join."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """First `k` rows per group (pruned before the shuffle by the group limit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def exact_percentiles(df: DataFrame, value: str, percents: dict[str, int], accuracy: int = 10_000) -> DataFrame:
    """Nearest-rank percentiles of an integer column, exact, as one row.

    Two passes. A mergeable quantile sketch, whose ranks are off by at most one in `accuracy`, brackets each percentile by
    two values. The second pass counts what lies below a bracket, and the values inside it one by one: about four rows in
    `accuracy`, the only ones that are ever put in order, each bracket in a task of its own.
    """
    margin = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p / 100 + d)) for p in percents.values() for d in (-margin, margin)]
    sketch = df.agg(F.count(value).alias("total"), F.percentile_approx(value, ends, accuracy).alias("ends")).first()
    total, found = sketch["total"], sketch["ends"] or [None] * len(ends)
    v = F.col(value)
    places = []
    for i, name in enumerate(percents):
        low, high = found[2 * i], found[2 * i + 1]
        # NULL stands for all values below the bracket; it comes first in order.
        places.append(F.when(v <= high, F.struct(F.lit(name).alias("name"), F.when(v >= low, v).alias("v"))))
    counted = df.where(v.isNotNull()).select(F.explode(F.array_compact(F.array(*places))).alias("x")).groupBy("x.name", "x.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto)
    rank = {name: (total * p + 99) // 100 for name, p in percents.items()}
    hit = {name: (F.col("name") == name) & (F.col("upto") - F.col("n") < r) & (F.col("upto") >= r) for name, r in rank.items()}
    return placed.agg(*[F.max(F.when(h, F.col("v"))).alias(name) for name, h in hit.items()])
