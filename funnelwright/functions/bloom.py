"""Bloom filters: built by one small aggregation, tested as a Column inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 64
HASHES = 4


def _places(key: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(words * WORD_BITS)) for j in range(HASHES)]


def bloom_filter(df: DataFrame, key: str, words: int = 64) -> list[int]:
    """Filter over the values of `key`: `words` longs, whatever the number of rows; these alone reach the driver.

    Sixteen bits a key leave about 0.2 % of other keys in, so `words` should be a quarter of the keys; more keys leave more
    in and none of the wanted out.
    """
    place = F.explode(F.array(*_places(F.col(key), words))).alias("place")
    bits = df.select(place).select(
        F.floor(F.col("place") / WORD_BITS).alias("word"), F.expr(f"shiftleft(1L, CAST(place % {WORD_BITS} AS INT))").alias("bits")
    )
    found = {r["word"]: r["bits"] for r in bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()}
    return [found.get(word, 0) for word in range(words)]


def might_hold(bloom: list[int], key: Column) -> Column:
    """False only for keys that are not among those of the filter."""
    words = F.expr("array(" + ", ".join(f"{w}L" if w > -(1 << 63) else "shiftleft(1L, 63)" for w in bloom) + ")")
    places = _places(key, len(bloom))
    tests = [F.getbit(F.get(words, F.floor(p / WORD_BITS).cast("int")), (p % WORD_BITS).cast("int")) == 1 for p in places]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out
