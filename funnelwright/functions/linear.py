"""Small dense matrices as array Columns, folded inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A pivot below this part of its variance is taken for rounding.
SINGULAR = 1e-9


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once instead of once per element."""
    return F.get(F.transform(F.array(value), use), 0)


def cholesky(matrix: Column) -> Column:
    """Columns of a factor L with L L' = matrix (symmetric, semidefinite; array<array<double>>).

    A direction without variance left gets a column of zeros.
    """
    none = F.array().cast("array<array<double>>")

    def step(columns: Column, k: Column) -> Column:
        def left(c: Column, i: Column) -> Column:
            return c - F.aggregate(columns, F.lit(0.0), lambda total, l: total + F.get(l, i) * F.get(l, k))

        def scaled(rest: Column) -> Column:
            pivot = F.get(rest, k)
            some = pivot > SINGULAR * F.get(F.get(matrix, k), k)
            return F.transform(rest, lambda v, i: F.when(some & (i >= k), v / F.sqrt(pivot)).otherwise(0.0))

        return F.concat(columns, F.array(bound(F.transform(F.get(matrix, k), left), scaled)))

    return F.aggregate(F.sequence(F.lit(0), F.size(matrix) - 1), none, step)


def combination(columns: Column, weights: Column, i: Column) -> Column:
    """Element i of the sum of the columns times their weights."""
    return F.aggregate(F.zip_with(columns, weights, lambda c, w: F.get(c, i) * w), F.lit(0.0), lambda total, x: total + x)
