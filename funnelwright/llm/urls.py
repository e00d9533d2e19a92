"""URL filter: rules first, then the ratio of two character models.

Rules are a short list of (verdict, host, path); the longest that fits decides. URLs that rules accept and reject are the
learning rows of two variable-order Markov models with Witten-Bell smoothing (see `charlm`): the longest known context
counts, interpolated with the shorter ones. All their grams count, however many there are. A URL's score is the difference of its log-likelihoods per character. The
threshold is calibrated on a fifth of the ruled URLs, chosen by hash, which the models never see: half-way between the
5th percentile of the accepted and the 95th of the rejected.

Defined cases: null, or no `://`: host and path are empty and no rule fits; null and empty URLs score 0; with one verdict
only, or none, among the learning rows the models say nothing and every score is 0, as is the threshold, which accepts;
repeated rows count each time; an empty table gives an empty result. Added columns take a leading underscore where the
input already has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charlm
from .common import bounded_batches, free_name

# (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
VERDICTS = ["allow", "block"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class UrlModel:
    model: charlm.Model | charlm.Tables
    threshold: float


def _scored(df: DataFrame, model: charlm.Model | charlm.Tables, url_column: str, name: str) -> DataFrame:
    if isinstance(model, charlm.Tables):
        out = model.add_totals(df, url_column, name)
        sums, chars = F.col(f"{name}.sums"), F.col(f"{name}.chars")
        return out.withColumn(name, (sums[0] - sums[1]) / F.greatest(chars, F.lit(1)))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the entries it was fitted with

    @F.arrow_udf("double")
    def ratio(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in columns:
            sums, sizes = charlm.totals(shared.value, urls)
            difference = sums[:, 0] - sums[:, 1] if sums.shape[1] == 2 else np.zeros(len(sums))
            yield pa.array(difference / np.maximum(sizes, 1))

    return bounded_batches(df).withColumn(name, ratio(F.col(url_column).cast("string")))


def fit(labelled: DataFrame, url_column: str = "url", verdict_column: str = "verdict", entries: int | None = charlm.ENTRIES) -> UrlModel:
    """From URLs with a verdict (allow or block; others are left out). More than `entries` grams stay in tables, see `charlm`."""
    rows = labelled.select(F.col(verdict_column).alias("class"), F.col(url_column).cast("string").alias("text"))
    rows = rows.where(F.col("class").isin(VERDICTS) & F.col("text").isNotNull())
    fold = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(5))
    if len(rows.where(fold != 0).select("class").distinct().collect()) < 2:
        return UrlModel(charlm.Model([], charlm.Alphabet("url")), 0.0)
    model = charlm.fit_whole(rows.where(fold != 0), "url", "witten-bell", VERDICTS, entries)
    checked = _scored(rows.where(fold == 0), model, "text", "ratio").groupBy("class")
    ends = {r["class"]: r["q"] for r in checked.agg(F.percentile_approx("ratio", [0.05, 0.95], 10_000).alias("q")).collect()}
    return UrlModel(model, (ends["allow"][0] + ends["block"][1]) / 2 if len(ends) == 2 else 0.0)


def judge(df: DataFrame, url_column: str = "url", rules: list[tuple[str, str, str]] = RULES, entries: int | None = charlm.ENTRIES) -> DataFrame:
    """df plus host, path, rule, ratio (null where a rule decides) and verdict. For `entries` see `fit`."""
    url = F.col(url_column).cast("string")
    host, path, ruled, unruled = (free_name(df, c) for c in ("host", "path", "ruled", "unruled"))
    known = df.withColumns({host: host_of(url), path: path_of(url)}).withColumn(ruled, rule_of(F.col(host), F.col(path), rules))
    found = fit(known.select(url.alias("url"), F.col(f"{ruled}.verdict").alias("verdict")), entries=entries)
    ratio = free_name(df, "ratio")
    out = _scored(known.withColumn(unruled, F.when(F.col(ruled).isNull(), url)), found.model, unruled, ratio)
    verdict = F.coalesce(F.col(f"{ruled}.verdict"), F.when(F.col(ratio) >= found.threshold, "allow").otherwise("block"))
    return out.select(
        *[F.col(f"`{c}`") for c in [*df.columns, host, path]],
        F.col(f"{ruled}.rule").alias(free_name(df, "rule")),
        F.when(F.col(ruled).isNull(), F.col(ratio)).alias(ratio),
        verdict.alias(free_name(df, "verdict")),
    )
