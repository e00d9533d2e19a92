"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

1. `pieces`: tokens of each whole document; only documents longer than a sequence are cut.
2. Pieces are dealt by hash into instances of about `ITEMS` pieces: small enough for a task, large enough that the one bin
   an instance may waste is well under a thousandth. Repeated rows are dealt by row number, so they spread as well.
3. Each instance lives on several islands: one state row each, with a small population of packings. The first packing is
   best-fit decreasing, the others best-fit of a perturbed order. A generation crosses two parents: whole well-filled bins
   of one are injected into the other, bins that hold a piece a second time are taken apart, and the displaced pieces go
   in by best fit. An instance at its lower bound of bins rests.
4. Between epochs each island's best packing moves to the next island, by a join on (instance, island); each epoch is
   stored. At the end the best packing of each instance counts.

Defined cases: null text is empty: one piece with the closing id alone; a piece as long as a sequence is a sequence; ties go to
the lower island; repeated rows are packed each; null ids are ordinary; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, releasing, slices, stored
from .tokens import word_tokenizer

LENGTH = 4096
CLOSING = 1
ITEMS = 4096
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 6, 10, 3
SEED = 20240607
# Bytes of text whose words are looked up together.
SLICE_BYTES = 1 << 22
_PIECE = "piece int, start long, length long, ids_crc32 long"
_STATE = "instance long, island int, uids binary, lengths binary, packings binary, bins int, fill double, solved boolean"


@releasing
def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = word_tokenizer(tokenizer)
    closing = CLOSING.to_bytes(4, "little")
    for batch in batches:
        row, number, start, length, crc, tokens = [], [], [], [], [], []
        texts = batch.column("text")
        for low, high in slices(texts, SLICE_BYTES):
            found, ends = own.encode_column(texts.slice(low, high - low))
            for i, (first, last) in enumerate(itertools.pairwise(ends.tolist()), low):
                ids = found[first:last].tobytes() + closing
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row.append(i)
                    number.append(piece)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        tokens.append(part)
        columns = [batch.column("id").take(pa.array(row, pa.int32())), pa.array(number, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(tokens, pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)
    own.forget()


def pieces(df: DataFrame, id_column: str, text_column: str, tokenizer: str, size: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; with_ids adds the ids, 4 bytes each."""
    rows = bounded_batches(df).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {_PIECE}" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(partial(_cut, tokenizer=tokenizer, size=size, with_ids=with_ids), schema)


class BestFit:
    """Bins by free room; an item goes to the fullest bin that takes it, or to a new one."""

    def __init__(self, loads: list[int], size: int) -> None:
        self.size, self.count = size, len(loads)
        self.room = sorted((size - load, i) for i, load in enumerate(loads))

    def add(self, length: int) -> int:
        at = bisect.bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, number = self.room.pop(at)
        else:
            free, number = self.size, self.count
            self.count += 1
        bisect.insort(self.room, (free - length, number))
        return number


def best_fit(lengths: np.ndarray, order: np.ndarray, size: int, packing: np.ndarray | None = None) -> np.ndarray:
    """Bin of each item after placing `order` into `packing` (-1: not placed yet)."""
    packing = np.full(len(lengths), -1, np.int32) if packing is None else packing
    placed = packing >= 0
    fit = BestFit(np.bincount(packing[placed], lengths[placed]).astype(int).tolist() if placed.any() else [], size)
    packing[order] = [fit.add(x) for x in lengths[order].tolist()]
    return packing


def _renumbered(packing: np.ndarray) -> np.ndarray:
    """Bins from 0 without gaps; -1 stays."""
    used = np.unique(packing[packing >= 0])
    out = np.full(len(packing), -1, np.int32)
    out[packing >= 0] = np.searchsorted(used, packing[packing >= 0])
    return out


def quality(lengths: np.ndarray, packing: np.ndarray, size: int) -> tuple[int, float]:
    """Bins, and how unevenly they are filled (fuller bins first): smaller is better in both."""
    loads = np.bincount(packing, lengths)
    return len(loads), -float(np.square(loads / size).sum())


def cross(lengths: np.ndarray, into: np.ndarray, of: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A child of `into` with whole well-filled bins of `of`."""
    loads = np.bincount(of, lengths)
    good = np.flatnonzero(loads >= np.median(loads))
    chosen = np.zeros(len(loads), bool)
    chosen[rng.choice(good, max(1, len(good) // 2), replace=False)] = True
    taken = chosen[of]
    broken = np.zeros(into.max() + 1, bool)
    broken[into[taken]] = True
    child = np.where(broken[into], -1, into)
    child[taken] = into.max() + 1 + of[taken]
    out = np.flatnonzero(child < 0)
    return best_fit(lengths, out[np.argsort(-lengths[out], kind="stable")], size, _renumbered(child))


def evolve(lengths: np.ndarray, population: list[np.ndarray], size: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first; a child replaces the worst it beats."""
    least = math.ceil(lengths.sum() / size)
    ranked = sorted(((quality(lengths, p, size), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for step in range(generations):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = cross(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], size, rng)
        score = quality(lengths, child, size)
        if score < ranked[-1][0]:
            ranked[-1] = (score, len(population) + step, child)
            ranked.sort(key=lambda x: x[:2])
    return [p for *_, p in ranked]


def _row(instance: int, island: int, uids: np.ndarray, lengths: np.ndarray, population: list[np.ndarray], size: int) -> dict:
    bins, fill = quality(lengths, population[0], size)
    return {
        "instance": instance,
        "island": island,
        "uids": uids.tobytes(),
        "lengths": lengths.astype(np.int32).tobytes(),
        "packings": np.stack(population).astype(np.int32).tobytes(),
        "bins": bins,
        "fill": fill,
        "solved": bins <= math.ceil(lengths.sum() / size),
    }


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in _STATE.split(", "))]))


def _settle(items: pa.Table, size: int, islands: int, population: int) -> pa.Table:
    """First packings of one instance, for each of its islands."""
    order = np.argsort(items.column("uid").to_numpy())
    uids, lengths = (items.column(c).to_numpy()[order] for c in ("uid", "length"))
    instance = items.column("instance")[0].as_py()
    rows = []
    for island in range(islands):
        rng = np.random.default_rng([SEED, instance, island])
        first: list[np.ndarray] = []
        for i in range(population):
            noise = 1 + (0.0 if i == 0 else 0.1 * i) * rng.random(len(lengths))
            first.append(best_fit(lengths, np.argsort(-lengths * noise, kind="stable"), size))
            if i == 0 and quality(lengths, first[0], size)[0] <= math.ceil(lengths.sum() / size):
                break
        rows.append(_row(instance, island, uids, lengths, sorted(first, key=lambda p: quality(lengths, p, size)), size))
    return _table(rows)


@releasing
def _epoch(batches: Iterator[pa.RecordBatch], size: int, generations: int, epoch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            packings = np.frombuffer(row["packings"] + (row["guest"] or b""), np.int32).reshape(-1, len(lengths))
            # The guest takes the last place, so the population stays as large as it was.
            members = [p for i, p in enumerate(packings) if row["guest"] is None or i != len(packings) - 2 or len(packings) < 3]
            rng = np.random.default_rng([SEED, row["instance"], row["island"], epoch])
            best = evolve(lengths, members, size, generations, rng)
            rows.append(_row(row["instance"], row["island"], np.frombuffer(row["uids"], np.int64), lengths, best, size))
        yield from _table(rows).to_batches()


@releasing
def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            uids, lengths = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            packing = np.frombuffer(row["packings"], np.int32)[: len(uids)]
            order = np.argsort(packing, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            first = np.concatenate([[True], np.diff(packing[order]) > 0])
            offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
            sequence = row["instance"] * 2 * ITEMS * 16 + packing[order]
            yield pa.RecordBatch.from_arrays([pa.array(uids[order]), pa.array(sequence.astype(np.int64)), pa.array(offset)], ["uid", "sequence_id", "offset"])


def pack(lengths: DataFrame, size: int = LENGTH, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid: distinct long, length: long, 1 to size), stored."""
    alone = lengths.where(F.col("length") == size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = lengths.where(F.col("length") < size)
    instances = max(1, math.ceil(items.count() / ITEMS))
    items = items.withColumn("instance", F.pmod(F.xxhash64("uid", F.lit(SEED)), F.lit(instances)).cast("long"))

    def settle(instance: pa.Table) -> pa.Table:
        return _settle(instance, size, islands, POPULATION)

    state = stored(items.groupBy("instance").applyInArrow(settle, _STATE), "islands")
    for epoch in range(epochs):
        if state.where("NOT solved").isEmpty():
            break
        guests = state.select("instance", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), _first().alias("guest"))
        met = state.join(guests, ["instance", "island"], "left")
        state = stored(met.mapInArrow(partial(_epoch, size=size, generations=GENERATIONS, epoch=epoch), _STATE), "islands")
    best = state.groupBy("instance").agg(F.min_by(F.struct("uids", "lengths", "packings"), F.struct("bins", "fill", "island")).alias("b"))
    return best.select("instance", "b.*").mapInArrow(_unpacked, "uid long, sequence_id long, offset long").union(alone)


def _first() -> Column:
    """The best packing: as many bytes as the lengths take."""
    return F.substring("packings", F.lit(1), F.length("lengths"))


def pack_documents(
    df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", size: int = LENGTH, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids), sequence_id and offset."""
    cut = stored(pieces(df, id_column, text_column, tokenizer, size, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("uid", "length"), size)
    return cut.join(placed, "uid").drop("uid").withColumnRenamed("id", id_column)
