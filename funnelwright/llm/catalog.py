"""The registered query of each corpus operator: (spark, folder) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from . import divergence, embeddings, langid, pieces, urls
from .licenses import find_licenses
from .packing import pack_documents
from .quality import judge_hosts, measure
from .secrets import BASE, find_secrets, listed
from .sharding import deal
from .simhash import near_duplicates
from .substring import dedup_substrings
from .whitening import whiten


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(documents(spark, folder).select("doc_id", "text"), model)
    whole = F.coalesce(pieces.decoded(F.col("ids"), model) == F.col("text"), F.col("text").isNull())
    return encoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), whole.alias("lossless"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    dealt = deal(docs.withColumn("size", size), 8, "size")
    return dealt.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(measure(documents(spark, folder).select("doc_id", "source", "text")).drop("text"), "measures")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"]
    return judge_hosts(measured).select(*names)


def fold(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    # Fold 0 is held out, fold 1 calibrates the rejection, the others are counted.
    detector = langid.fit(docs, fold() > 1, fold() == 1)
    found = langid.detect(docs.select("doc_id", "text"), detector)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(documents(spark, folder).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = dedup_substrings(documents(spark, folder).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_licenses(documents(spark, folder).select("doc_id", "text"))
    starts, by_phrase, by_template = F.col("places.start"), F.col("places.label"), F.col("matches.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(by_phrase)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(by_phrase, by_template)), ",").alias("labels"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("score"),
    )


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whiten(table(spark, folder, "embeddings"))
    by_component = F.posexplode(F.arrays_zip("whitened", F.slice("explained", 1, F.size("whitened")).alias("explained")))
    rows = white.select("vec_id", "n", "deviation", "identity_error", by_component.alias("place", "one"))
    component = (F.col("place") + 1).cast("int").alias("component")
    return rows.select("vec_id", component, "n", "deviation", "one.whitened", "one.explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_source_divergence": op12_source_divergence,
    "op13_embedding_whitening": op13_embedding_whitening,
}
