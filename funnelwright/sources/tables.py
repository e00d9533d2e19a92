"""Readers and writers: the session table and the named result tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RAW_SESSION


def write_sessions(nested: DataFrame, path: str) -> None:
    """Store nested session rows, one folder per day.

    Range partitioning by the whole row key gives each task a stretch of days
    (few files per folder) and still splits a busy day or a busy visitor; the
    pieces of one long row may lie in several files.
    """
    keys = ["date", "fullVisitorId", "visitId", *(["piece"] if "piece" in nested.columns else [])]
    (
        nested.repartitionByRange(*keys)
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(path)
    )


def write_bucketed_sessions(nested: DataFrame, table: str, path: str, buckets: int) -> None:
    """Store nested session rows as the catalog table `table`, by day and in buckets of visitors.

    All rows of a visitor lie in one bucket of each day, so whatever is grouped by visit or visitor is read as it lies,
    without an exchange. Each task writes one bucket; a bucket is as big as its busiest visitor at least.
    """
    (
        nested.repartition(buckets, "fullVisitorId")
        .write.mode("overwrite")
        .partitionBy("date")
        .bucketBy(buckets, "fullVisitorId")
        .sortBy("fullVisitorId", "visitId")
        .option("path", path)
        .saveAsTable(table)
    )


def read_bucketed_sessions(spark: SparkSession, table: str, start: str, end: str) -> DataFrame:
    """Session rows of the days `start`..`end` of a bucketed table."""
    return spark.table(table).where(F.col("date").between(start, end))


def read_sessions(
    spark: SparkSession, path: str, start: str, end: str, schema: str = RAW_SESSION
) -> DataFrame:
    """Session rows of the days `start`..`end`, both included.

    `date` is the partition column, so other days are never listed or opened.
    """
    return spark.read.schema(schema).parquet(path).where(F.col("date").between(start, end))


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result table with a declared schema; an empty cell is NULL."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_optional(spark: SparkSession, path: str, required: str) -> DataFrame | None:
    """Result table, or None when the path or a required column is missing.

    `required` declares the needed columns as DDL; others are kept as text.
    """
    try:
        found = spark.read.csv(path, header=True)
    except AnalysisException:
        return None
    types = dict(column.split(" ", 1) for column in required.split(", "))
    if not set(types) <= set(found.columns):
        return None
    return found.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def write_result(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Write a report table as CSV with a header, rounding only here.

    Report tables are aggregates of at most a few thousand rows, so they are
    written as one file.
    """
    for name, places in (digits or {}).items():
        df = df.withColumn(name, F.round(name, places))
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared folder, for stored intermediates.

    The cluster names that folder in `spark.checkpoint.dir`. Only a local
    master, whose tasks share one machine, may go without it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "funnelwright")
    return "/".join([base.rstrip("/"), "funnelwright", context.applicationId, f"{name}-{os.urandom(4).hex()}"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, however often it is read, and safe from lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
