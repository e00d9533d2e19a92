"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

How it runs:

1. Each task hashes every window of its rows from one running sum. A window gets 64 stored bits and, from a second
   polynomial, a bucket. The hashes of a slice of rows go out packed, one binary value a bucket; of windows that repeat within a slice
   of the task's rows one goes out, so a passage shared by a third of all documents shrinks before the shuffle.
2. Each bucket (memory-sized; their number follows the input) finds the hashes it holds more than once and returns, for
   rows that have any, one byte a window: repeated or not. These marks travel packed by lane, a hash range of the rows. Rows are known by hashes of their id and text, so nothing
   depends on partitions, batches or retries.
3. Rows meet their marks in a left join, hash their windows again (same buckets, same order), merge marked windows into
   maximal intervals and drop the covered words.

Two windows are held equal if their 64 bits and their bucket are. As buckets grow in number with the input, the chance of
a false match stays near (windows in a bucket) / 2**64 for a window at any size: about 1e-13.

Defined cases: null text has no words and gives empty kept text; texts shorter than the window lose nothing; repeated
rows, also with the same id, repeat each other's windows; null ids are ordinary; an empty table gives an empty result.
Added columns take a leading underscore where the input already has their name.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, bounded_batches, free_name, mix, release, releasing, shuffle_partitions, slices, utf8, word_bounds, word_hashes

WINDOW = 35
# Windows in a bucket: 32 MB of hashes, held twice (as they came and in one piece) and put in order range by range.
BUCKET_WINDOWS = 1 << 22
RANGES = 16
# Windows hashed at a time: the running sums need powers for as many words, and a Python worker keeps those.
STRETCH = 1 << 15
SLICE_BYTES = 1 << 21
_FIRST, _SECOND = RollingHash(0xD1B54A32D192ED03), RollingHash(0x8CB92BA72F3D8DD7)

SENT, KNOWN = 1, 2
# Rows travel packed. `keys`: two 64-bit hashes for each text; `counts`: its windows in this bucket; then their flags or
# marks, one byte each, and the 64-bit hashes of those that are sent.
_SENT = "bucket int, keys binary, counts binary, flags binary, hashes binary"
_BACK = "lane int, bucket int, keys binary, counts binary, marks binary"
_MARKS = "k1 long, k2 long, buckets binary, counts binary, marks binary"
RESULT = "n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _windows(words: np.ndarray, first: np.ndarray, window: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Start word, row, hash and bucket of each window, in order."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(np.arange(len(words)) + window <= first[1:][rows])
    hashes, bucket = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    for low in range(0, len(starts), STRETCH):
        own = slice(low, low + STRETCH)
        first, at = starts[low], starts[own] - starts[low]
        part = words[first : first + at[-1] + window]
        hashes[own] = mix(_FIRST(part, at, at + window))
        bucket[own] = mix(_SECOND(mix(part), at, at + window)) % np.uint64(buckets)
    return starts, rows[starts], hashes, bucket


def _pieces(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in `flat` and end at these elements."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _ends(*values: np.ndarray) -> np.ndarray:
    """Where runs of equal values end."""
    change = np.ones(len(values[0]), bool)
    change[:-1] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return np.flatnonzero(change) + 1


def _all(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a packed column, one after the other."""
    return np.frombuffer(b"".join(memoryview(x.as_buffer()) for x in column), kind)


@releasing
def _send(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
        for low, high in slices(batch.column(2), SLICE_BYTES):
            data, offsets = utf8(batch.column(2).slice(low, high - low))
            starts, ends, first = word_bounds(data, offsets)
            _, rows, hashes, bucket = _windows(word_hashes(data, starts, ends), first, window, buckets)
            if not len(rows):
                continue
            order = np.argsort(hashes, kind="stable")
            same = hashes[order[1:]] == hashes[order[:-1]]
            flags = np.full(len(rows), SENT, np.uint8)
            flags[order[1:][same]] = KNOWN
            flags[order[:-1][same]] |= KNOWN
            order = np.argsort(bucket, kind="stable")
            rows, bucket, flags, hashes = rows[order], bucket[order], flags[order], hashes[order]
            texts = _ends(bucket, rows)
            of_bucket = _ends(bucket[texts - 1])
            sent = flags & SENT > 0
            whole = texts[of_bucket - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[whole - 1].astype(np.int32)),
                    _pieces(keys[low + rows[texts - 1]].ravel(), 2 * of_bucket),
                    _pieces(np.diff(texts, prepend=0).astype(np.int32), of_bucket),
                    _pieces(flags, whole),
                    _pieces(hashes[sent], np.cumsum(sent)[whole - 1]),
                ],
                ["bucket", "keys", "counts", "flags", "hashes"],
            )


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """For each hash: is it there more than once? They are scrambled, so ranges of them are about equally large."""
    repeated, part = np.zeros(len(hashes), bool), np.empty(len(hashes), np.uint8)
    for low in range(0, len(hashes), STRETCH):
        part[low : low + STRETCH] = (hashes[low : low + STRETCH] >> np.uint64(32)) * np.uint64(RANGES) >> np.uint64(32)
    for i in range(RANGES):
        at = np.flatnonzero(part == i)
        order = at[np.argsort(hashes[at])]
        own = hashes[order]
        same = own[1:] == own[:-1]
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
    return repeated


def _marks(bucket: pa.Table) -> np.ndarray:
    """One byte for each window of a bucket: repeated or not."""
    flags = _all(bucket.column("flags"), np.uint8)
    marks = (flags & KNOWN > 0).astype(np.uint8)
    marks[flags & SENT > 0] |= _repeated(_all(bucket.column("hashes"), np.uint64))
    return marks


def _count(bucket: pa.Table, lanes: int) -> pa.Table:
    """Which windows of one bucket occur more than once: texts that have any, packed by where they return to."""
    marks = _marks(bucket)
    keys = _all(bucket.column("keys"), np.int64).reshape(-1, 2)
    counts = _all(bucket.column("counts"), np.int32)
    some = np.add.reduceat(marks, np.cumsum(counts) - counts, dtype=np.int64) > 0
    marks, keys, counts = marks[np.repeat(some, counts)], keys[some], counts[some]
    lane = (mix(keys[:, 0].view(np.uint64)) % np.uint64(lanes)).astype(np.int64)
    order = np.argsort(lane, kind="stable")
    marks = marks[np.argsort(np.repeat(lane, counts), kind="stable")]
    keys, counts, lane = keys[order], counts[order], lane[order]
    ends = _ends(lane) if len(lane) else np.zeros(0, np.int64)
    return pa.table(
        {
            "lane": pa.array(lane[ends - 1].astype(np.int32)),
            "bucket": pa.array(np.full(len(ends), bucket.column("bucket")[0].as_py(), np.int32)),
            "keys": _pieces(keys.ravel(), 2 * ends),
            "counts": _pieces(counts, ends),
            "marks": _pieces(marks, np.cumsum(counts)[ends - 1]),
        }
    )


def _gather(lane: pa.Table) -> pa.Table:
    """One row per text: its marks of all buckets, by bucket. Equal rows (same id and text) share their marks."""
    keys = _all(lane.column("keys"), np.int64).reshape(-1, 2)
    counts, marks = _all(lane.column("counts"), np.int32), _all(lane.column("marks"), np.uint8)
    sizes = [len(x.as_buffer()) // 4 for x in lane.column("counts")]
    bucket = np.repeat(lane.column("bucket").to_numpy(), sizes)
    order = np.lexsort((bucket, keys[:, 1], keys[:, 0]))
    starts = (np.cumsum(counts) - counts)[order]
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    marks = marks[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(marks))]
    last = _ends(keys[:, 0], keys[:, 1], bucket)
    if len(last) < len(keys):
        first = np.concatenate([[0], last[:-1]])
        at = np.cumsum(counts) - counts
        into = np.concatenate([np.tile(np.arange(at[a], at[a] + counts[a]), b - a) for a, b in zip(first, last, strict=True)])
        np.maximum.at(marks, into, marks.copy())
        marks = marks[np.repeat(np.isin(np.arange(len(keys)), first), counts)]
        keys, counts, bucket = keys[first], counts[first], bucket[first]
    ends = _ends(keys[:, 0], keys[:, 1])
    return pa.table(
        {
            "k1": pa.array(keys[ends - 1, 0]),
            "k2": pa.array(keys[ends - 1, 1]),
            "buckets": _pieces(bucket.astype(np.int32), ends),
            "counts": _pieces(counts, ends),
            "marks": _pieces(marks, np.cumsum(counts)[ends - 1]),
        }
    )


def _cut(words: np.ndarray, window: int, buckets: int, own: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each word of one text: is it covered by a marked window?"""
    starts, _, _, bucket = _windows(words, np.array([0, len(words)]), window, buckets)
    order = np.argsort(bucket, kind="stable")
    at = np.repeat(np.searchsorted(bucket[order], own) - (np.cumsum(counts) - counts), counts) + np.arange(len(marks))
    hit = starts[order[at[marks > 0]]]
    step = np.zeros(len(words) + 1, np.int64)
    step[hit] += 1
    np.subtract.at(step, hit + window, 1)
    return np.cumsum(step[:-1]) > 0


@releasing
def _apply(columns: Iterator[tuple[pa.Array, ...]], window: int, buckets: int) -> Iterator[pa.Array]:
    for texts, own, counts, marks in columns:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, *packed in zip(texts, own, counts, marks, strict=True):
            words = (text.as_py() or "").encode().split()
            gone: list[dict] = []
            n = len(words)
            if packed[0].is_valid and n:
                data, offsets = utf8(pa.array([text.as_py()]))
                starts, ends, _ = word_bounds(data, offsets)
                packed = [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.int32, np.int32, np.uint8), strict=True)]
                cut = _cut(word_hashes(data, starts, ends), window, buckets, *packed)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                gone = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                words = list(itertools.compress(words, (~cut).tolist()))
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
            removed.append(gone)
        yield pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            ["n_words", "n_removed", "kept_text", "removed"],
        )


def dedup_substrings(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """df plus n_words, n_removed, kept_text (kept words joined by one space) and removed (word intervals).

    A word goes if a window covering it has a word sequence that also starts anywhere else, in this text or another.
    """
    if window < 1:
        raise ValueError("a window holds one word at least")
    total = bounded_batches(df).agg(F.sum(F.octet_length(F.col(text_column)))).first()[0] or 0
    buckets = max(1 + total // 6 // BUCKET_WINDOWS, shuffle_partitions(df.sparkSession))
    keys = [F.xxhash64(F.col(id_column)), F.xxhash64(F.col(text_column))]
    sent = df.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        partial(_send, window=window, buckets=buckets), _SENT
    )

    def count(bucket: pa.Table) -> pa.Table:
        marks = _count(bucket, buckets)
        release()
        return marks

    def gather(lane: pa.Table) -> pa.Table:
        marks = _gather(lane)
        release()
        return marks

    back = sent.groupBy("bucket").applyInArrow(count, _BACK)
    marks = back.groupBy("lane").applyInArrow(gather, _MARKS)
    k1, k2, *packed = (free_name(df, c.split(" ")[0]) for c in _MARKS.split(", "))
    marks = marks.toDF(k1, k2, *packed)
    apply = F.arrow_udf(_iterator(window, buckets), RESULT)
    found = free_name(df, "found")
    joined = df.withColumns({k1: keys[0], k2: keys[1]}).join(marks, [k1, k2], "left")
    joined = joined.withColumn(found, apply(F.col(text_column).cast("string"), *packed))
    added = [F.col(found)[n].alias(free_name(df, n)) for n in ("n_words", "n_removed", "kept_text", "removed")]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def _iterator(window: int, buckets: int) -> Callable:
    def cut(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _apply(columns, window, buckets)

    return cut
