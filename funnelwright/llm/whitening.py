"""Embedding whitening: spectral divide and conquer by QDWH, then one broadcast matrix.

1. Entries become whole numbers x = floor(1024 c) + 100000. One pass sums them by dimension (exact longs).
2. A second pass centres each vector on the whole-numbered mean, multiplies, and sums the products exactly: the matrix
   products run in doubles on parts small enough to stay whole, and the sums are kept in two halves of 40 bits. So the
   covariance does not depend on partitions, order or retries, and is rounded once. Each task sends one line per dimension;
   the lines of a dimension are summed in a group of their own.
3. The covariance (dimensions squared, whatever the number of rows) is split on the driver: the polar factor of the
   covariance less a shift, by dynamically weighted Halley steps on QR factors, gives the projector on the directions above
   the shift; the two invariant subspaces are split again until only single components are left.
4. The components (dimensions x components doubles) are broadcast, and each task projects its rows.

Defined cases. Rows whose vector is null, empty, or has null or non-finite entries are left out, as are vectors with an
entry of 2^33 or more, whose exact deviation no long could hold. Vectors of different lengths are spaces of their own, each
with its own fit. Repeated rows count each time; a null id is an id like any other. A direction without variance (up to
rounding) has a null `whitened`, and a space without any variance a null `explained` too. A deviation beyond a long is null.
An empty table gives an empty result. Columns of the input other than the id and the vector are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, releasing, stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = float(1 << 33)
_LOW = 40
_MASK = (1 << _LOW) - 1
_HALF = 20
_ROWS = 64  # products of 23-bit parts, summed over so many rows, stay below 2^53
_EPS = float(np.finfo(np.float64).eps)


# Spectral divide and conquer


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a square matrix, by dynamically weighted Halley steps on QR factors."""
    n = len(a)
    scale = np.linalg.norm(a)
    if not scale:
        return np.eye(n)
    u = a / scale
    triangle = np.linalg.qr(u, mode="r")
    # 1 / |R^-1| bounds the smallest singular value from below; a singular matrix has the floor.
    low = max(_EPS, 1 / float(np.linalg.norm(np.linalg.inv(triangle)))) if np.abs(np.diag(triangle)).min() > _EPS else _EPS
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        first = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * u, np.eye(n)]))
        following = (second / third) * u + (first - second / third) / np.sqrt(third) * (q[:n] @ q[n:].T)
        change = np.linalg.norm(following - u)
        u, low = following, min(1.0, low * (first + second * square) / (1 + third * square))
        if abs(1 - low) < 10 * _EPS and change < np.cbrt(4 * _EPS):
            break
    return u


def split_subspace(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces of a symmetric matrix above and below a shift."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    projector = (projector + projector.T) / 2
    above = int(np.clip(round(float(np.trace(projector))), 0, n))
    # The range of the projector, by two rounds of subspace iteration: its eigenvalues are 0 and 1 alone.
    q = np.random.default_rng(n).standard_normal((n, above))
    for _ in range(2):
        q, _ = np.linalg.qr(projector @ q)
    whole, _ = np.linalg.qr(np.hstack([q, np.random.default_rng(n + 1).standard_normal((n, n - above))]))
    for _ in range(2):  # the rest is the range of the complement
        rest, _ = np.linalg.qr((np.eye(n) - projector) @ whole[:, above:]) if above < n else (whole[:, n:], None)
        whole = np.hstack([q, rest])
    return q, whole[:, above:]


def components_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, by recursive splitting."""
    norm = np.linalg.norm(a)

    def divide(part: np.ndarray, basis: np.ndarray) -> list[tuple[float, np.ndarray]]:
        n = len(part)
        off = part - np.diag(np.diag(part))
        if n == 1 or np.linalg.norm(off) <= _EPS * norm:
            return [(float(part[i, i]), basis[:, i]) for i in range(n)]
        # Shifts are tried until one divides: the middle of the diagonal first, then the mean of the eigenvalues' bounds.
        diagonal, spread = np.sort(np.diag(part)), np.linalg.norm(off)
        for shift in (float(np.median(diagonal)), float(diagonal.mean()), *(float(diagonal.mean() + t * spread) for t in (0.1, -0.1, 0.5, -0.5))):
            upper, lower = split_subspace(part, shift)
            # A shift beside an eigenvalue leaves the halves coupled; the next one is tried then.
            if 0 < upper.shape[1] < n and np.linalg.norm(lower.T @ part @ upper) <= 100 * n * _EPS * norm:
                out = []
                for q in (upper, lower):
                    inner = q.T @ part @ q
                    out += divide((inner + inner.T) / 2, basis @ q)
                return out
        # Eigenvalues too close to tell apart: any orthonormal basis of the space serves.
        return [(float(part[i, i]), basis[:, i]) for i in range(n)]

    found = sorted(divide(a, np.eye(len(a))), key=lambda pair: -pair[0]) if norm else [(0.0, v) for v in np.eye(len(a))]
    values, vectors = np.array([v for v, _ in found]), np.array([v for _, v in found]).T
    # One orthogonal correction of the whole basis takes up what the recursion rounded away, and signs are made definite.
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)
    return values, vectors


# Exact moments


@dataclass(frozen=True)
class Space:
    """Fit of all vectors of one length."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # one column per component

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    @property
    def centre(self) -> np.ndarray:
        """The mean's whole part."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean less its whole part."""
        return np.array([(s % self.n) / self.n for s in self.sums])

    def has_variance(self, k: int) -> bool:
        return bool(self.values[k] > 8 * len(self.sums) * _EPS * max(self.values[0], 0.0))


def _usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def entries(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, size, x) of the vectors that count; x: whole numbers."""
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    rows = rows.where(_usable(F.col("vector")))
    whole = F.transform("vector", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET).cast("long"))
    return rows.select("id", F.size("vector").alias("size"), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


@releasing
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each length, in halves; one line per length and task."""
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, rows in _by_size(batch):
            x = _matrix(rows.column("x"))
            n[size] = n.get(size, 0) + len(x)
            held = sums.setdefault(size, np.zeros((2, size), np.int64))
            held += [(x >> _HALF).sum(axis=0), (x & ((1 << _HALF) - 1)).sum(axis=0)]
    for size, held in sums.items():
        yield pa.RecordBatch.from_pydict(
            {
                "size": pa.array([size], pa.int32()),
                "n": pa.array([n[size]], pa.int64()),
                "high": pa.array([held[0].tolist()], pa.list_(pa.int64())),
                "low": pa.array([held[1].tolist()], pa.list_(pa.int64())),
            }
        )


def whole_products(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z.T @ z for whole numbers below 2^43, exactly, as (high, low) with value = high * 2^40 + low."""
    high, low = (np.zeros((z.shape[1], z.shape[1]), np.int64) for _ in range(2))

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64)

    for start in range(0, len(z), _ROWS):
        part = z[start : start + _ROWS]
        upper, lower = part >> _HALF, part & ((1 << _HALF) - 1)
        square = product(lower, lower)
        high += square >> _LOW
        low += square & _MASK
        if upper.any():
            cross = product(upper, lower)
            cross = cross + cross.T
            high += product(upper, upper) + (cross >> _HALF)
            low += (cross & ((1 << _HALF) - 1)) << _HALF
    return high + (low >> _LOW), low & _MASK


@releasing
def _products(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred entries: one line per length, dimension and task."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for size, rows in _by_size(batch):
            high, low = whole_products(_matrix(rows.column("x")) - centres[size])
            if size in sums:
                high, low = high + sums[size][0], low + sums[size][1]
            sums[size] = [high + (low >> _LOW), low & _MASK]
    for size, (high, low) in sums.items():
        for start in range(0, size, 256):
            lines = range(start, min(start + 256, size))
            yield pa.RecordBatch.from_pydict(
                {
                    "size": pa.array([size] * len(lines), pa.int32()),
                    "line": pa.array(lines, pa.int32()),
                    "high": pa.array([high[i].tolist() for i in lines], pa.list_(pa.int64())),
                    "low": pa.array([low[i].tolist() for i in lines], pa.list_(pa.int64())),
                }
            )


def _sum_lines(lines: pa.Table) -> pa.Table:
    """Sum of the tasks' lines of one dimension: tasks x dimensions numbers."""
    size, line = lines.column("size")[0].as_py(), lines.column("line")[0].as_py()
    high, low = (lines.column(c).combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0) for c in ("high", "low"))
    return pa.table(
        {
            "size": pa.array([size], pa.int32()),
            "line": pa.array([line], pa.int32()),
            "high": pa.array([(high + (low >> _LOW)).tolist()], pa.list_(pa.int64())),
            "low": pa.array([(low & _MASK).tolist()], pa.list_(pa.int64())),
        }
    )


def fit(rows: DataFrame) -> dict[int, Space]:
    """The fit of each vector length; rows: what `entries` gives, stored."""
    counted = rows.select("size", "x").mapInArrow(_sums, "size int, n long, high array<long>, low array<long>")
    totals = counted.select("size", "n", F.posexplode(F.arrays_zip("high", "low")).alias("line", "sums"))
    totals = totals.groupBy("size", "line").agg(
        F.sum("n").alias("n"), F.sum(F.col("sums.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("sums.low").cast("decimal(38,0)")).alias("low")
    )
    # One line per length and dimension, whatever the number of rows.
    sizes: dict[int, dict[int, tuple[int, int]]] = {}
    for r in totals.collect():
        sizes.setdefault(r["size"], {})[r["line"]] = (r["n"], (int(r["high"]) << _HALF) + int(r["low"]))
    moments = {s: (lines[0][0], tuple(lines[i][1] for i in range(s))) for s, lines in sizes.items()}
    centres = {s: np.array([v // n for v in sums], np.int64) for s, (n, sums) in moments.items()}
    lines = rows.select("size", "x").mapInArrow(partial(_products, centres=centres), "size int, line int, high array<long>, low array<long>")
    lines = lines.groupBy("size", "line").applyInArrow(_sum_lines, "size int, line int, high array<long>, low array<long>")
    found: dict[int, dict[int, list[int]]] = {}
    for r in lines.collect():
        found.setdefault(r["size"], {})[r["line"]] = [(h << _LOW) + low for h, low in zip(r["high"], r["low"], strict=True)]
    return {s: _space(n, sums, centres[s], found[s]) for s, (n, sums) in moments.items()}


def _space(n: int, sums: tuple[int, ...], centre: np.ndarray, products: dict[int, list[int]]) -> Space:
    d = len(sums)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]  # n times the mean less its whole part
    # Products about the whole part of the mean, less what that part leaves over: exact, then rounded once.
    covariance = np.array([[float(Fraction(n * products[i][j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    return Space(n, sums, covariance, *components_of(covariance))


def _deviations(x: np.ndarray, space: Space) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    z, rest = x - space.centre, np.array([s % space.n for s in space.sums], np.int64)
    largest = (int(np.abs(z).max(initial=0)) + 1) * space.n
    if largest * largest * len(rest) < 1 << 63:
        return (((z * space.n) - rest) ** 2).sum(axis=1).tolist()
    exact = ((z.astype(object) * space.n - rest.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


@releasing
def _whiten(batches: Iterator[pa.RecordBatch], model, components: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, rows in _by_size(batch):
            space: Space = model.value[size]
            x = _matrix(rows.column("x"))
            k = min(components, size)
            keep = [j for j in range(k) if space.has_variance(j)]
            white = np.full((len(x), k), np.nan)
            if keep:
                centred = (x - space.centre).astype(np.float64) - space.rest
                white[:, keep] = centred @ space.vectors[:, keep] / np.sqrt(space.values[keep])
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    rows.column("size"),
                    pa.array(_deviations(x, space), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k), pa.int32()), flat),
                ],
                ["id", "size", "deviation", "whitened"],
            )


def identity_error(whitened: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(size, identity_error): how far the covariance of the whitened rows is from the identity, over components with variance."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = [F.get("whitened", i) for i in range(components)]
    # covar_pop keeps running means, so it centres before it multiplies; a null column gives null and is skipped.
    moments = whitened.groupBy("size").agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs])
    errors = [F.abs(F.col(f"c{i}_{j}") - (1.0 if i == j else 0.0)) for i, j in pairs]
    return moments.select("size", (F.greatest(*errors) if len(errors) > 1 else errors[0]).alias("identity_error"))


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts: id, size, n, deviation, whitened and explained (arrays by component), identity_error."""
    if components < 1:
        raise ValueError("one component at least")
    spark = df.sparkSession
    rows = stored(bounded_batches(entries(df, id_column, vector_column)), "whole-vectors")
    spaces = fit(rows)
    model = spark.sparkContext.broadcast(spaces)
    kind = rows.schema["id"].dataType.simpleString()
    white = rows.mapInArrow(partial(_whiten, model=model, components=components), f"id {kind}, size int, deviation long, whitened array<double>")
    white = stored(white, "whitened")
    facts = [
        (size, s.n, [float(v) / s.trace if s.trace > 0 else None for v in s.values[:components]]) for size, s in spaces.items()
    ]
    facts = spark.createDataFrame(facts, "size int, n long, explained array<double>")
    out = white.join(facts, "size").join(identity_error(white, components), "size")
    return out.select(F.col("id").alias(id_column), "size", "n", "deviation", "whitened", "explained", "identity_error")
