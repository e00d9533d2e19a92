"""Connected components by alternating large-star and small-star steps, in DataFrame functions.

Each step is one aggregation (the smallest neighbour of a node, summed map-side) and one join; its edges are stored in the
shared folder, so a lost executor costs a stage, not the run. No node's neighbours are ever gathered: a node with a third
of all edges is a skewed join, which adaptive execution splits. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, stored


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and edges (a, b): the smallest node each can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node, from it to the smallest node it reaches by the given edges."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = smallest(len(nodes), inverse[: len(a)], inverse[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


@releasing
def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = spanning(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _lowest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from each node to others, and each node's smallest neighbour or itself."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges, lowest


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge in `edges` (a, b: long); the component is its smallest node."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = stored(now.mapInArrow(_thin, "a long, b long").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        whole, lowest = _lowest(both)
        large = stored(whole.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        whole, lowest = _lowest(large)
        small = whole.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
