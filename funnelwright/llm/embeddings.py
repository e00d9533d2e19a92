"""Embedding near-dedup by sorted projection passes.

1. Equal vectors become one class with a count, so copies cost nothing afterwards.
2. Each pass orders the classes by 64 concatenated random-hyperplane signs (range partitioning and a sort, nothing gathered)
   and compares each with its `WINDOW` successors by cosine in double precision; a window that crosses a partition's edge
   is finished in a second, small step on the rows along the edges. Verified pairs of all passes are united in `graph`.
3. A window is bounded, a group of near copies is not. So links are counted exactly inside each component afterwards: its
   classes are dealt out as pairs of chunks of `CHUNK` vectors, so a group with a third of all vectors spreads over many
   tasks, and only counts leave a task. The cost is square in the size of a component, a matrix product of small chunks.

A pair at the threshold differs in a hash bit with probability angle / pi = 0.10. It meets in a window if it agrees in about
log2(classes / WINDOW) leading bits, so `passes` must grow with the logarithm of the input: the default asks for a miss
rate of one per cent at the threshold, and far less for closer pairs.

Defined cases: null, empty and zero vectors and vectors with null or non-finite components link with nothing; vectors of
different length never link; a repeated row is a vector of its own; a null id never names a component, and is null in the
result; an empty table gives an empty result. Other columns of the input are kept out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, shuffle_partitions, stored, whole_groups
from .graph import components, spanning

THRESHOLD = 0.95
WINDOW = 64
CHUNK = 1024
SEED = 20240607
MISS = 0.01
_PASS = "a long, b long, edge long, side int, place int, vector array<double>"


def passes_for(classes: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with probability `miss`."""
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(2, classes) / window) + 1)
    return max(4, math.ceil(math.log(miss) / math.log(1 - agree)))


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of one length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@releasing
def _keys(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """Each class once for each pass, with its sort key: 64 hyperplane signs, most significant first."""
    for batch in batches:
        lengths = batch.column("size").to_numpy()
        for size in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == size)))
            unit = _matrix(rows.column("vector"))
            for k in range(passes):
                planes = np.random.default_rng([SEED, k, int(size)]).standard_normal((int(size), 64))
                bits = np.packbits(unit @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
                signed = (bits ^ np.uint64(1 << 63)).view(np.int64)  # the same order in signed longs
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k, np.int32)), rows.column("size"), pa.array(signed), rows.column("class"), rows.column("vector")],
                    ["pass", "size", "key", "class", "vector"],
                )


def _near(unit: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart with at least this cosine."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(unit), 256):
        high = min(low + 256, len(unit))
        a, b = np.nonzero(unit[low:high] @ unit[low : high + window].T >= threshold)
        right = (b > a) & (b - a <= window)
        found_a.append(a[right] + low)
        found_b.append(b[right] + low)
    return np.concatenate(found_a), np.concatenate(found_b)


@releasing
def _windows(batches: Iterator[pa.RecordBatch], window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links within one range partition; its first and last rows go out too, for the windows across its edges."""
    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    names = ["a", "b", "edge", "side", "place", "vector"]

    def out(a: np.ndarray, b: np.ndarray | None, side: int = 0, vectors: pa.Array | None = None) -> pa.RecordBatch:
        n = len(a)
        edge, place = (np.full(n, part + side, np.int64), np.arange(n, dtype=np.int32)) if vectors is not None else (None, None)
        columns = [a, b, edge, np.full(n, side, np.int32), place, vectors]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    tail, first = None, True
    for batch in batches:
        lengths = batch.column("size").to_numpy()
        for size in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == size)))
            rows = pa.Table.from_batches([rows]).select(["pass", "size", "class", "vector"]).combine_chunks()
            if tail is not None and tail.column("size")[0].as_py() == size:
                rows = pa.concat_tables([tail, rows]).combine_chunks()
            if first:
                head = rows.slice(0, window)
                yield out(head.column("class").to_numpy(), None, 0, head.column("vector").combine_chunks())
                first = False
            classes, of_pass = rows.column("class").to_numpy(), rows.column("pass").to_numpy()
            a, b = _near(_matrix(rows.column("vector")), window, threshold)
            same = of_pass[a] == of_pass[b]
            yield out(*spanning(classes[a[same]], classes[b[same]]))
            tail = rows.slice(max(0, len(rows) - window))
    if tail is not None:
        yield out(tail.column("class").to_numpy(), None, 1, tail.column("vector").combine_chunks())


@releasing
def _across(edges: Iterator[pa.RecordBatch], window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for groups in whole_groups(edges, "edge"):
        edge = groups.column("edge").to_numpy()
        for number in np.unique(edge):
            rows = groups.take(pa.array(np.flatnonzero(edge == number)))
            lengths = rows.column("vector").combine_chunks().value_lengths().to_numpy()
            for size in np.unique(lengths):
                own = rows.take(pa.array(np.flatnonzero(lengths == size)))
                # The rows before the edge, then those behind it.
                order = np.lexsort((own.column("place").to_numpy(), -own.column("side").to_numpy()))
                own = own.take(pa.array(order))
                classes = own.column("a").to_numpy()
                a, b = spanning(*(classes[x] for x in _near(_matrix(own.column("vector")), window, threshold)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """Links (a, b) that span the pairs found in all passes; classes: (class, size, vector), stored."""
    passes = passes or passes_for(classes.count(), threshold, window)
    keyed = classes.select("class", "size", "vector").mapInArrow(
        partial(_keys, passes=passes), "pass int, size int, key long, class long, vector array<double>"
    )
    ordered = keyed.repartitionByRange(max(2, shuffle_partitions(classes.sparkSession)), "size", "pass", "key", "class")
    ordered = ordered.sortWithinPartitions("size", "pass", "key", "class")
    found = stored(ordered.mapInArrow(partial(_windows, window=window, threshold=threshold), _PASS), "projection-passes")
    edges = found.where("edge IS NOT NULL").repartition("edge").sortWithinPartitions("edge")
    across = edges.mapInArrow(partial(_across, window=window, threshold=threshold), "a long, b long")
    return found.where("edge IS NULL").select("a", "b").union(across)


@releasing
def _counted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Linked vectors of each class within one pair of chunks."""
    for groups in whole_groups(batches, "key"):
        key, side, n = (groups.column(c).to_numpy() for c in ("key", "side", "n"))
        classes = groups.column("class").to_numpy()
        out = np.zeros(len(classes), np.int64)
        for low, high in zip(*(lambda e: (np.concatenate([[0], e[:-1]]), e))(np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1), strict=True):
            own = side[low:high]
            unit = _matrix(groups.column("vector").slice(low, high - low))
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            near &= (own[:, None] == 0) | (own[:, None] != own[None, :])
            out[low:high] = near @ n[low:high]
        yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(out)], ["class", "links"])


def count_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class, links): vectors of other classes of its component that each class is linked with.

    members: (component, class, n, vector) of all classes that have a link, stored.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, "component").withColumn("c", F.pmod(F.xxhash64("class", F.lit(SEED)), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = dealt.select(
        F.xxhash64("component", F.least("c", "other"), F.greatest("c", "other")).alias("key"),
        F.when(F.col("c") == F.col("other"), 0).when(F.col("c") < F.col("other"), 1).otherwise(2).alias("side"),
        "class",
        "n",
        "vector",
    )
    pairs = pairs.repartition("key").sortWithinPartitions("key")
    return pairs.mapInArrow(partial(_counted, threshold=threshold), "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    passes: int | None = None,
) -> DataFrame:
    """One row per row of df: its id, n_links, component_id (the smallest id it reaches) and kept."""
    if not 0 < threshold <= 1 or window < 1:
        raise ValueError("a cosine above 0 and a window of one vector at least")
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(_valid(F.col("vector")), F.col("vector")))
    keys = {"h1": F.xxhash64("vector", F.lit(1)), "h2": F.xxhash64(F.lit(2), "vector")}
    rows = rows.withColumns({k: F.when(F.col("vector").isNotNull(), v) for k, v in keys.items()})
    classes = rows.where("vector IS NOT NULL").groupBy("h1", "h2")
    classes = classes.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("vector").alias("vector"))
    classes = stored(classes.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("class")), "vector-classes")
    reached = stored(components(links(classes, threshold, window, passes)), "vector-components")
    members = stored(
        classes.join(reached, classes["class"] == reached["node"]).select("component", "class", "n", "vector", "first"), "linked-vectors"
    )
    named = members.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = members.select("class", "component").join(named, "component").join(count_links(members, threshold), "class")
    known = classes.select("h1", "h2", "class", "n", "first").join(linked.select("class", "component_id", "links"), "class", "left")
    known = known.select(
        "h1",
        "h2",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.least(F.coalesce("component_id", "first"), "first").alias("component_id"),
    )
    out = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
