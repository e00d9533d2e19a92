"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of the record. Pass two shuffles each
bucket by Fisher and Yates and deals it out. Law `rows`: the buckets stand one after the other, place g of that order
goes to shard g mod n, slot g div n, so shards differ by one row at most and every slot is filled.

* A record is known by two hashes over its columns. Records that repeat count in one row of the census. Copies of a record
  that alone would fill a good part of a bucket are spread over all buckets: one of them stands for all and is written out
  again as often as the census counted it, copy i with a hash of its own. So the deal depends on the records, the seed and
  the size of a bucket alone, not on partitions, settings or retries; any of the copies may take any of their places.
* The permutation of each bucket is drawn by Spark's `shuffle`, which is Fisher and Yates's algorithm, with a seed, and is
  stored before it is used: a retried task finds the same one. Which task draws it depends on the buckets alone. It holds row numbers, not rows: 4 bytes a record, for the
  rows of one bucket. Rows are numbered in the order of their hashes by an external sort, and never gathered in an array.
* The text crosses the network once. Only the census of buckets (one row each) is summed over, in two levels.

Defined cases: null columns hash as nulls; repeated rows take a place each; an empty table gives an empty result. Added
columns take a leading underscore where the input already has their name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored

SEED = 20240607
# Text bytes of a bucket.
BUCKET_BYTES = 4 << 20
_GROUP = 1024
_COPIES = 4096


def scatter(df: DataFrame, size_column: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str, int]:
    """df plus two record hashes and its bucket; the name of the bucket's column; and the number of buckets."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    record = [F.xxhash64(F.lit(seed), *columns), F.xxhash64(*columns, F.lit(seed))]
    census = stored(
        df.select(record[0].alias("r1"), record[1].alias("r2"), F.col(size_column).cast("long").alias("size"))
        .groupBy("r1", "r2")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")),
        "shard-census",
    )
    total = census.agg(F.sum("size"), F.sum("n")).first()
    buckets = max(1, math.ceil((total[0] or 0) / bucket_bytes))
    often = (F.col("n") > 1) & ((F.col("size") > bucket_bytes // 16) | (F.col("n") * 16 * buckets > (total[1] or 0)))
    heavy = stored(census.where(often).select("r1", "r2", "n"), "shard-heavy")
    r1, r2, bucket, copies, part, copy = (free_name(df, c) for c in ("r1", "r2", "bucket", "copies", "part", "copy"))
    heavy = heavy.toDF(r1, r2, copies)
    known = df.withColumns({r1: record[0], r2: record[1]})
    light = known.join(heavy, [r1, r2], "left_anti").withColumn(copy, F.lit(None).cast("long"))
    # One record of each kind, then its copies in parts of `_COPIES`, dealt out before they are written out.
    one = known.join(heavy, [r1, r2], "left_semi").groupBy(r1, r2).agg(*[F.first(c).alias(n) for c, n in zip(columns, df.columns, strict=True)])
    parts = one.join(heavy, [r1, r2]).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(_COPIES).cast("long"))))
    last = F.least(F.col(part) + _COPIES, F.col(copies)) - 1
    again = parts.repartition(r1, part).withColumn(copy, F.explode(F.sequence(F.col(part), last)))
    joined = light.select(*columns, r1, r2, copy).unionByName(again.select(*columns, r1, r2, copy))
    joined = joined.withColumn(bucket, F.pmod(F.xxhash64(r2, r1, F.lit(seed), copy), F.lit(buckets)).cast("int"))
    return joined.select(*columns, r1, r2, bucket), bucket, buckets


def deal(df: DataFrame, shards: int, size_column: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df plus shard and slot, in the order of the shuffled buckets."""
    if shards < 1:
        raise ValueError("one shard at least")
    scattered, bucket, buckets = scatter(df, size_column, seed, bucket_bytes)
    r1, r2 = scattered.columns[-3:-1]
    counts = stored(scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), "shard-buckets")
    inside = Window.partitionBy("group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    grouped = counts.withColumn("group", F.floor(F.col(bucket) / _GROUP))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("n").alias("of_group")).withColumn("above", F.coalesce(F.sum("of_group").over(before), F.lit(0)))
    order, first = free_name(scattered, "order"), free_name(scattered, "first")
    placed = grouped.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups.select("group", "above"), "group")
    placed = placed.select(F.col(bucket), (F.col("own") + F.col("above")).alias(first), "n")
    # Spark draws from one generator per task, so tasks and the order in them must follow from the buckets alone.
    placed = placed.repartition(math.ceil(buckets / _GROUP), bucket).sortWithinPartitions(bucket)
    drawn = stored(placed.select(bucket, first, F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(seed)).alias(order)), "shard-orders")
    rank, place = free_name(scattered, "rank"), free_name(scattered, "place")
    numbered = scattered.withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(r1, r2)))
    placed = numbered.join(drawn.hint("merge"), bucket).withColumn(place, F.col(first) + F.get(F.col(order), F.col(rank) - 1))
    shard, slot = free_name(df, "shard"), free_name(df, "slot")
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.pmod(F.col(place), F.lit(shards)).cast("int").alias(shard),
        F.floor(F.col(place) / shards).cast("long").alias(slot),
    )


def write_shards(dealt: DataFrame, path: str) -> None:
    """Write the records as one folder per shard, each task a sorted stretch of slots, so that no shard is one task."""
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
