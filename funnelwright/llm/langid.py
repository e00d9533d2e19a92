"""Language ID by interpolated Kneser-Ney character models, one per language.

The text's language is the one of lowest cross-entropy per character. Rejection is calibrated on rows that the models have
not seen: per band of text length (powers of two), the threshold is `SLACK` times the `QUANTILE` quantile of the
cross-entropies under the labelled language. A band with fewer than `LEAST` such rows rejects nothing.

Learning counts all labelled rows (see `charlm`); scoring reads whole texts, in the row, without a shuffle.

Defined cases: null text, and text without a letter, is `und` with score 0 and counts as rejected; with no labelled rows
every text is; ties go to the language first in order; rows with null language are not learned from; repeated rows count
each time; an empty table gives an empty result. Added columns take a leading underscore where the input has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charlm
from .common import bounded_batches, free_name, releasing

UNKNOWN = "und"
QUANTILE, SLACK, LEAST = 0.999, 1.15, 20
LANGUAGES = 256
_RESULT = "lang_pred string, score double, cross_entropy double, chars long"


@dataclass
class Detector:
    model: charlm.Model
    thresholds: dict[int, float]


def _predict(model: charlm.Model, texts: pa.Array) -> pa.Array:
    sums, sizes = charlm.totals(model, texts)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    known = letters & (len(model.classes) > 0)
    entropy = -sums / np.maximum(sizes, 1)[:, None]
    names, score, best = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if len(model.classes):
        choice, best = entropy.argmin(axis=1), entropy.min(axis=1)
        odds = np.exp(-(entropy - best[:, None]) * np.minimum(sizes, 50)[:, None])
        score = np.where(known, 1 / odds.sum(axis=1), 0.0)
        names = [model.classes[c] if k else UNKNOWN for c, k in zip(choice, known, strict=True)]
    return pa.StructArray.from_arrays(
        [pa.array(names, pa.string()), pa.array(score), pa.array(best), pa.array(sizes)], ["lang_pred", "score", "cross_entropy", "chars"]
    )


@releasing
def _predictions(model: charlm.Model, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in columns:
        yield _predict(model, texts)


def _scored(df: DataFrame, model: charlm.Model, text_column: str, name: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the entries it was fitted with

    @F.arrow_udf(_RESULT)
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _predictions(shared.value, columns)

    return bounded_batches(df).withColumn(name, predict(F.col(text_column).cast("string")))


def _band(chars: Column) -> Column:
    return F.floor(F.log2(F.greatest(chars, F.lit(1)))).cast("int")


def fit(
    df: DataFrame, learn: Column, calibrate: Column, text_column: str = "text", lang_column: str = "lang", entries: int | None = charlm.ENTRIES
) -> Detector:
    """Models from rows where `learn`, thresholds from rows where `calibrate`. For `entries` see `charlm`."""
    labelled = df.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = labelled.where(learn).select(F.col(lang_column).cast("string").alias("class"), F.col(text_column).cast("string").alias("text"))
    classes = sorted(r[0] for r in rows.select("class").distinct().limit(LANGUAGES + 1).collect())
    if len(classes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    model = charlm.fit(rows, "letters", "kneser-ney", classes, entries)
    checked = _scored(labelled.where(calibrate).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")), model, "text", "found")
    checked = checked.where("found.lang_pred = lang").groupBy(_band(F.col("found.chars")).alias("band"))
    bands = checked.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("found.cross_entropy", QUANTILE, 10_000).alias("q")).collect()
    return Detector(model, {r["band"]: SLACK * r["q"] for r in bands if r["n"] >= LEAST})


def detect(df: DataFrame, detector: Detector, text_column: str = "text") -> DataFrame:
    """df plus lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected."""
    found = free_name(df, "found")
    out = _scored(df, detector.model, text_column, found)
    pairs = [x for band, limit in sorted(detector.thresholds.items()) for x in (F.lit(band), F.lit(limit))]
    limit = F.create_map(*pairs)[_band(F.col(f"{found}.chars"))] if pairs else F.lit(None).cast("double")
    rejected = (F.col(f"{found}.lang_pred") == UNKNOWN) | F.coalesce(F.col(f"{found}.cross_entropy") > limit, F.lit(False))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col(f"{found}.{c}").alias(free_name(df, c)) for c in ("lang_pred", "score", "cross_entropy")],
        rejected.alias(free_name(df, "rejected")),
    )
