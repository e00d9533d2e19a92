"""SimHash near-dedup with pivot distance tables.

1. Fingerprints: each bit is the majority of that bit over the XXH64 values of a text's shingles. Equal fingerprints are
   one row from here on, so copies cost nothing.
2. Candidates: two fingerprints within d bits agree in b - d of any b blocks of bits. Each goes to the group of every
   choice of b - d blocks, with b from 5 up as their number grows: groups stay small, and no pair is missed at any b.
   (Pivot distances alone would not do: for unrelated texts they all lie near 32, so a grid over them reads most pairs.)
3. Groups larger than `GROUP` are dealt out as pairs of chunks, so no group is one task. Within a group, the table of
   Hamming distances to reference fingerprints (`pivots`) discards a pair as soon as one coordinate differs by more than d
   (triangle inequality); survivors are verified bit by bit.
4. A task returns links that span what it found linked, at most one per fingerprint: never all pairs of a group.
   Components follow in `graph`.

Defined cases: null text and text without words have fingerprint zero and link as any other; a text with fewer words than a
shingle is one shingle; rows with a null id get the component of their fingerprint but never name one (a component of null
ids only is null); repeated rows are linked with each other; an empty table gives an empty result. Added columns take a
leading underscore where the input already has their name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, releasing, slices, stored, utf8, whole_groups, word_bounds
from .graph import components, spanning

SHINGLE = 4
BITS = 4
SEED = 42
PIVOTS = 16
GROUP = 1024
# Expected number of unrelated fingerprints in a group.
PER_GROUP = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASH_SLICE = 1 << 15


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    data, offsets = utf8(texts)
    starts, _, first = word_bounds(data, offsets)
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    raw = data.tobytes().translate(_LOWER)
    for row in np.flatnonzero(np.diff(first)):
        n = int(first[row + 1] - first[row])
        joined = b" ".join(raw[offsets[row] : offsets[row + 1]].split())
        view = np.frombuffer(joined, np.uint8)
        cuts = np.concatenate([[-1], np.flatnonzero(view == 32), [len(view)]])
        size = min(shingle, n)
        lows, highs = (cuts[: n - size + 1] + 1).tolist(), cuts[size:].tolist()
        ones = np.zeros(64, np.int64)
        for at in range(0, len(lows), _HASH_SLICE):
            h = [digest(joined[a:b], SEED) for a, b in zip(lows[at : at + _HASH_SLICE], highs[at : at + _HASH_SLICE], strict=True)]
            ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > len(lows)).view(">u8")[0]
    return out


def with_fingerprints(df: DataFrame, text_column: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """df plus the fingerprint of the whole text, as a signed long."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        parts = [fingerprints(texts.slice(low, high - low), shingle) for low, high in slices(texts)]
        return pa.array(np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64))

    return bounded_batches(df).withColumn(name, fingerprint(F.col(text_column).cast("string")))


def block_masks(rows: int, bits: int) -> list[int]:
    """Masks of 64 bits such that any two values within `bits` bits agree under one of them."""
    for blocks in itertools.count(bits + 1):
        kept = blocks - bits
        if rows / 2 ** (64 * kept / blocks) <= PER_GROUP or blocks >= 2 * bits:
            break
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(whole, kept)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, dtype=np.uint64)


def linked_pairs(prints: np.ndarray, group: np.ndarray, side: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of one group within `bits` bits; rows of a group lie together.

    Rows of side 1 are compared with rows of side 2 only (two chunks of a large group), rows of side 0 with each other.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)
    change = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    ends = np.repeat(change[1:], np.diff(change))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left = np.arange(len(prints))
    for step in range(1, int(np.diff(change).max(initial=0))):
        left = left[left + step < ends[left]]
        a, b = left, left + step
        both = side[a] != side[b]
        if side.any():
            a, b = a[both | (side[a] == 0)], b[both | (side[a] == 0)]
        for k in range(table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, k] - table[b, k]) <= bits
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= bits
        if near.any():
            found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@releasing
def _link(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for groups in whole_groups(batches, "key"):
        key, prints, side = (groups.column(c).to_numpy() for c in ("key", "fp", "side"))
        a, b = linked_pairs(prints.view(np.uint64), key, side, bits)
        low, high = spanning(prints[a], prints[b])
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that span all fingerprints within `bits` bits; prints: one row per fingerprint (`fp`), stored."""
    masks = block_masks(prints.count(), bits)
    keyed = prints.select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])).alias("key")
    )
    large = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), "large-groups")
    joined = keyed.join(large, "key", "left")
    small = joined.where("n IS NULL").select("key", "fp", F.lit(0).cast("long").alias("side"))
    # A large group of c chunks: each row meets the rows of every chunk, once.
    chunks = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = joined.where("n IS NOT NULL").withColumn("c", F.pmod(F.xxhash64("fp", F.lit(SEED)), chunks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pair = dealt.select(
        F.xxhash64("key", F.least("c", "other"), F.greatest("c", "other")).alias("key"),
        "fp",
        F.when(F.col("c") == F.col("other"), 0).when(F.col("c") < F.col("other"), 1).otherwise(2).cast("long").alias("side"),
    )
    groups = small.union(pair).repartition("key").sortWithinPartitions("key", "fp")
    return groups.mapInArrow(partial(_link, bits=bits), "a long, b long")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """One row per row of df: its id, fingerprint (16 hex digits) and component_id, the smallest id it reaches."""
    if not 0 <= bits < 32 or shingle < 1:
        raise ValueError("0 to 31 bits and shingles of one word at least")
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = stored(with_fingerprints(rows, "text", "fp", shingle).select("id", "fp"), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    reached = stored(components(links(prints, bits)), "print-components")
    named = prints.join(reached, prints["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named-prints")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = named.join(least, "component").select("fp", "component_id")
    return rows.join(of_print, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
