"""Tail probabilities and Poisson draws as Column expressions.

Used on aggregates only (groups by steps, or replicates by patterns). Loops
are array folds, so nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distribution function of a unit Poisson draw, up to the resolution of `uniform`.
UNIT_CDF = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def _log_gamma_half(df: Column) -> Column:
    """ln Gamma(df / 2) for a whole number df >= 1."""
    start = F.when(df % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi)))
    first = F.when(df % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    factors = F.when(df > 2, F.sequence(F.lit(1), F.ceil(df / 2).cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(factors, start, lambda total, i: total + F.log(first + i - 1))


def chi_square_tail(chi2: Column, df: Column) -> Column:
    """P(X >= chi2) for a chi-square variable with a whole number of degrees of freedom.

    Regularised upper incomplete gamma: power series below the mean, continued
    fraction above it. Both need most terms where chi2 is near df: a multiple
    of the root of df.
    """
    s, x = df / F.lit(2.0), chi2 / F.lit(2.0)
    depth = (F.lit(300) + F.ceil(20 * F.sqrt(s))).cast("int")
    scale = F.exp(s * F.log(x) - x - _log_gamma_half(df))
    series = F.aggregate(
        F.sequence(F.lit(1), depth),
        F.struct((F.lit(1.0) / s).alias("term"), (F.lit(1.0) / s).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * x / (s + k)).alias("term"), (acc["total"] + acc["term"] * x / (s + k)).alias("total")
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(
        F.sequence(depth, F.lit(1), F.lit(-1)),
        x + 1 - s + 2.0 * (depth.cast("double") + 1),
        lambda below, k: x + 1 - s + 2 * k - 2 - (k * (k - s)) / below,
    )
    tail = F.when(x < s + 1, F.lit(1.0) - scale * series).otherwise(scale / fraction)
    return F.when(chi2 <= 0, F.lit(1.0)).when(chi2.isNotNull() & df.isNotNull(), tail)


def uniform(key: Column, part: int = 0) -> Column:
    """A repeatable uniform in [0, 1) from 32 bits of the key's MD5."""
    digits = F.substring(F.md5(key), 1 + 8 * part, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def normal(key: Column) -> Column:
    """A repeatable standard normal: Box and Muller's transform of two uniforms of the key."""
    return F.sqrt(-2 * F.log(1 - uniform(key, 0))) * F.cos(2 * math.pi * uniform(key, 1))


def _log_factorial(k: Column) -> Column:
    """ln k! for a whole number k: Stirling's series from 16 on, the product below."""
    z = k + 1.0
    far = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return F.when(k < 16, F.log(F.factorial(k.cast("int")).cast("double"))).otherwise(far)


def poisson(rate: Column, u: Column) -> Column:
    """A Poisson draw with the given whole rate: the inverse of the distribution function at the uniform `u`.

    One method for every rate. The terms further than ten standard deviations
    below the rate are far under the resolution of `uniform` and are passed
    over, so the work grows with the root of the rate. The common rate 1
    compares with fixed bounds, which give the same draws. The sum of `rate`
    independent unit draws has this distribution.
    """
    rate = rate.cast("double")
    unit = F.when(u < UNIT_CDF[0], F.lit(0))
    for k, below in enumerate(UNIT_CDF[1:], start=1):
        unit = unit.when(u < below, F.lit(k))
    unit = unit.otherwise(F.lit(len(UNIT_CDF))).cast("bigint")
    low = F.greatest(F.floor(rate - 10 * F.sqrt(rate)), F.lit(0).cast("bigint"))
    last = F.ceil(rate + 10 * F.sqrt(rate) + 15).cast("bigint")
    least = F.when(low == 0, F.exp(-rate)).otherwise(F.exp(low * F.log(rate) - rate - _log_factorial(low)))
    inverse = F.aggregate(
        F.sequence(low + 1, last),
        F.struct(least.alias("p"), least.alias("cdf"), low.alias("k")),
        lambda acc, i: F.struct(
            (acc["p"] * rate / i).alias("p"),
            (acc["cdf"] + acc["p"] * rate / i).alias("cdf"),
            F.when(acc["cdf"] <= u, i).otherwise(acc["k"]).alias("k"),
        ),
        lambda acc: acc["k"],
    )
    return F.when(rate == 1, unit).otherwise(inverse)
