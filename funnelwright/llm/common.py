"""Helpers shared by the corpus operators: stored intermediates, free column names, words of whole Arrow columns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

# The word rule of all operators: runs of characters other than blank and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
# Texts are worked on in slices of about this many bytes; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
# Bytes whose words are hashed at a time; a longer word makes a stretch of its own.
STRETCH = 1 << 17
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and gives a known size."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded: ten thousand long texts at once would fill a Python worker."""
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def releasing(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """`task`, which gives freed memory back when it ends: a Python worker lives on, idle, beside the stages that follow."""

    @functools.wraps(task)
    def run(*args, **kwargs) -> Iterator:
        yield from task(*args, **kwargs)
        release()

    return run


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C libraries, glibc holds on to it and offers this
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or a variant that clashes with no column of df (names compare without case, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable is not built anew for each element, whatever is pushed down."""
    return F.get(F.transform(F.array(value), use), 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a whole text column, and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each, in order and without gaps."""
    _, offsets = utf8(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, len(column))
        low = high


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row its first word (n + 1 entries)."""
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of unsigned 64-bit values (SplitMix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Polynomial hashes modulo 2**64 of any stretch of a sequence, all from one running sum (Rabin and Karp's idea)."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair; equal stretches have equal hashes."""
        if len(self.up) <= len(values):
            size = max(1 << 16, 2 * len(values))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (self.base, self.inverse)
            )
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.down[: len(values)], out=total[1:])
        return (total[ends] - total[starts]) * self.up[starts]


_LETTERS = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_WORDS = RollingHash(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by byte bounds, in order; worked on in stretches, as each byte takes a few 8-byte numbers."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + STRETCH, side="right")))
        first, own = starts[low], slice(low, high)
        hashes = _WORDS(_LETTERS[data[first : ends[high - 1]]], starts[own] - first, ends[own] - first)
        out[own] = mix(hashes + (ends[own] - starts[own]).astype(np.uint64))
        low = high
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `key`; a group that spans batches is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        cut = int(np.searchsorted(column.to_numpy(), column[-1].as_py()))
        if held and held[0].column(key)[0].as_py() == column[-1].as_py():
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)
