"""Smoothed character models of several classes, counted by Spark and kept in sorted hash arrays.

A gram is five symbols of 12 bits in one long, so contexts and suffixes are shifts and masks in SQL. Symbols are fitted:
the 4,093 most frequent characters of the learning rows have one each, all rarer and unseen ones share `RARE`. Tasks
count the grams of their rows class by class in bounded arrays and send sums; all further statistics (continuation
counts, counts of counts, context totals) are aggregations over all of them.

The model of `fit` is bounded by `entries` grams over all classes and orders, so it can be broadcast at any size of
corpus: per class and order the rarest grams are left out by count, and what they held goes to the back-off weight of
their context, so that probabilities still sum to one. `entries=None` keeps every gram; then the model grows with the
corpus. `fit_whole` leaves nothing out: a model of more than `entries` grams stays in stored tables (`Tables`). There the
grams of the scored texts are priced by joins; the `entries` most frequent ones among them are broadcast with their
prices, all others are joined to their texts.

Model: for each order one array of sorted hashes with a row of log-probabilities, one per class, and the same for back-off
weights of contexts. Probabilities of an order are interpolated with the next lower one; unknown grams back off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, mix, releasing, slices, stored

ORDER = 5
SYMBOL_BITS = 12
SYMBOLS = 1 << SYMBOL_BITS
ENTRIES = 1 << 21
# Distinct grams a task holds before it sends what it has counted.
HELD = 1 << 19
# Scored at a time: a few arrays of eight bytes a character and class.
_SCORED_BYTES = 1 << 17
BLANK, RARE = 1, 2
_POINTS = 0x110000
_COUNTS = "class string, gram long, c long"


@cache
def _plain(kind: str) -> np.ndarray:
    """The character each code point stands for. `letters`: small letters, all else is BLANK. `url`: small letters, one digit, signs."""
    out = np.full(_POINTS, BLANK, np.uint32)
    # In stretches: a million characters at once would be as many Python objects in every worker.
    for low in range(0, _POINTS, 1 << 14):
        points = np.arange(low, min(low + (1 << 14), _POINTS), dtype=np.uint32)
        points = points[(points < 0xD800) | (points >= 0xE000)]
        chars = points.tobytes().decode("utf-32-le")
        small = np.array([ord(c.lower()[0]) for c in chars], np.uint32)
        if kind == "letters":
            wanted = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        else:
            wanted = np.ones(len(chars), bool)
            small[np.fromiter((c.isdigit() for c in chars), bool, len(chars))] = ord("0")
        out[points[wanted]] = small[wanted]
    return out


@dataclass(frozen=True)
class Alphabet:
    """Characters with a symbol of their own, the most frequent first."""

    kind: str
    points: tuple[int, ...] = ()


@cache
def _symbols(alphabet: Alphabet) -> np.ndarray:
    """Symbol of each code point."""
    of = np.full(_POINTS, RARE, np.uint16)
    of[list(alphabet.points)] = np.arange(RARE + 1, RARE + 1 + len(alphabet.points))
    of[BLANK] = BLANK
    return of[_plain(alphabet.kind)]


def _codes(texts: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)


@releasing
def _characters(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_POINTS, np.int64)
    for batch in batches:
        for low, high in slices(batch.column("text")):
            counts += np.bincount(_plain(kind)[_codes(batch.column("text").slice(low, high - low))], minlength=_POINTS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["point", "c"])


def alphabet_of(df: DataFrame, kind: str) -> Alphabet:
    """Of all rows of df (text, not null); equally frequent characters in order of code points."""
    found = bounded_batches(df).select("text").mapInArrow(partial(_characters, kind=kind), "point long, c long")
    found = found.where(F.col("point") != BLANK).groupBy("point").agg(F.sum("c").alias("c"))
    rows = found.orderBy(F.desc("c"), "point").limit(SYMBOLS - RARE - 1).collect()
    return Alphabet(kind, tuple(r["point"] for r in rows))


def grams(texts: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends in each character of each text (blanks stand before a text), and the texts' lengths."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
    codes = _codes(texts)
    padded = np.full(len(codes) + (ORDER - 1) * (len(lengths) + 1), BLANK, np.uint64)
    at = np.arange(len(codes)) + (ORDER - 1) * (1 + np.repeat(np.arange(len(lengths)), lengths))
    padded[at] = _symbols(alphabet)[codes]
    out = np.zeros(len(padded) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(SYMBOL_BITS)) | padded[i : i + len(out)]
    return out[at - (ORDER - 1)], lengths


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


@releasing
def _count(batches: Iterator[pa.RecordBatch], alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def sent(name: str) -> pa.RecordBatch:
        keys, counts = _merged(held.pop(name))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["class", "gram", "c"])

    for batch in batches:
        for low, high in slices(batch.column("text")):
            part = batch.slice(low, high - low)
            found, lengths = grams(part.column("text"), alphabet)
            names = part.column("class").dictionary_encode()
            of = np.repeat(names.indices.to_numpy(), lengths)
            for i, name in enumerate(names.dictionary.to_pylist()):
                keys, counts = np.unique(found[of == i], return_counts=True)
                parts = held.setdefault(name, [])
                parts.append((keys, counts))
                if sum(len(p[0]) for p in parts) > HELD:
                    held[name] = [_merged(parts)]
            while sum(len(p[0]) for x in held.values() for p in x) > 2 * HELD:
                yield sent(max(held, key=lambda x: sum(len(p[0]) for p in held[x])))
    for name in list(held):
        yield sent(name)


def count_grams(df: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(class, gram, c) over all rows of df (class: string, text: string; neither null), stored."""
    counted = bounded_batches(df).select("class", "text").mapInArrow(partial(_count, alphabet=alphabet), _COUNTS)
    return stored(counted.groupBy("class", "gram").agg(F.sum("c").alias("c")), "grams")


def _levels(counts: DataFrame, smoothing: str) -> list[DataFrame]:
    """Counts of order 1 to ORDER: Kneser-Ney counts in how many ways a lower gram continues one to the left."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        c = F.count(F.lit(1)) if smoothing == "kneser-ney" else F.sum("c")
        levels.append(stored(levels[-1].groupBy("class", _lower(order).alias("gram")).agg(c.alias("c")), f"grams-{order}"))
    return levels[::-1]


def _kept(counts: DataFrame, bound: int | None) -> Column:
    """Whether a gram stays: all grams of a class with as high a count do, as long as they are at most `bound`."""
    if bound is None:
        return F.lit(True)
    # Counts by quarter powers of two: a bounded table, from which the least kept count of each class follows.
    scale = F.floor(4 * F.log2("c")).cast("int")
    least: dict[str, int] = {}
    room: dict[str, int] = {}
    for name, step, n in sorted(counts.groupBy("class", scale.alias("step")).count().collect(), key=lambda r: (r[0], -r[1])):
        room[name] = room.get(name, bound) - n
        least[name] = step if room[name] >= 0 else least.get(name, step + 1)
    if not least:
        return F.lit(True)
    return scale >= F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("class")]


def _weighted(counts: DataFrame, smoothing: str, kept: Column) -> DataFrame:
    """The kept grams with alpha, what a gram keeps, and gamma, what its context leaves to the lower order.

    Gamma is one less the alphas of the context's kept grams, from whole numbers: the discounts, and all of the left out.
    """
    counts = counts.withColumns({"context": F.shiftright("gram", SYMBOL_BITS), "kept": kept})
    totals = counts.groupBy("class", "context").agg(
        F.sum("c").alias("total"),
        F.count(F.lit(1)).alias("types"),
        F.sum(F.when(F.col("kept"), F.col("c"))).alias("held"),
        F.count_if("kept").alias("held_types"),
    )
    out = counts.where("kept").join(totals.where("held_types > 0"), ["class", "context"])
    if smoothing == "kneser-ney":
        once = counts.groupBy("class").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        # n1 / (n1 + 2 n2), kept off its ends so that every context leaves something
        discount = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)), F.lit(0.5))))
        out = out.join(once.select("class", discount.alias("d")), "class")
        alpha = (F.col("c") - F.col("d")) / F.col("total")
        gamma = (F.col("total") - F.col("held") + F.col("d") * F.col("held_types")) / F.col("total")
    else:  # Witten-Bell: as many pseudo-counts for the lower order as there are types
        both = F.col("total") + F.col("types")
        alpha, gamma = F.col("c") / both, (both - F.col("held")) / both
    return out.select("class", "gram", "context", alpha.alias("alpha"), gamma.alias("gamma"))


class HashArray:
    """Rows of numbers under 64-bit keys: sorted hashes, with an index on their leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange(size + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        hashes = mix(keys)
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.hashes[here] == hashes[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Model:
    """Log-probability of the last symbol of a gram, for every class."""

    def __init__(self, classes: list[str], alphabet: Alphabet) -> None:
        self.classes, self.alphabet = classes, alphabet
        self.grams: list[HashArray] = []
        self.contexts: list[HashArray] = []

    def add(self, alpha: tuple[np.ndarray, ...], gamma: tuple[np.ndarray, ...]) -> None:
        """The next higher order: (class index, gram, alpha) and (class index, context, gamma)."""
        n = len(self.classes)
        keys, inverse = np.unique(gamma[1], return_inverse=True)
        weights = np.zeros((len(keys), n), np.float32)
        weights[inverse, gamma[0]] = np.log(gamma[2])
        self.contexts.append(HashArray(keys, weights))
        keys, inverse = np.unique(alpha[1], return_inverse=True)
        seen = np.zeros((len(keys), n))
        seen[inverse, alpha[0]] = alpha[2]
        order = len(self.grams) + 1
        lower = self._backed(keys, order)
        self.grams.append(HashArray(keys, np.log(seen + np.exp(lower)).astype(np.float32)))

    def _backed(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log of the weight of the context times the next lower order."""
        at = self.contexts[order - 1].find(keys >> np.uint64(SYMBOL_BITS))
        weight = np.zeros((len(keys), len(self.classes)), np.float32)
        weight[at >= 0] = self.contexts[order - 1].rows[at[at >= 0]]
        return weight + self.score(keys & np.uint64((1 << (SYMBOL_BITS * (order - 1))) - 1), order - 1)

    def score(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probabilities (grams x classes)."""
        if order == 0 or order > len(self.grams):
            return np.full((len(keys), len(self.classes)), -np.log(SYMBOLS), np.float32)
        at = self.grams[order - 1].find(keys)
        out = self.grams[order - 1].rows[at] if len(self.grams[order - 1].rows) else np.zeros((len(keys), len(self.classes)), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            out[missing] = self._backed(keys[missing], order)
        return out


@dataclass
class Tables:
    """A model too large to broadcast: of each order the alphas by gram and the gammas by context, an entry for each class."""

    classes: list[str]
    alphabet: Alphabet
    alphas: list[DataFrame]
    gammas: list[DataFrame]
    entries: int

    def priced(self, found: DataFrame) -> DataFrame:
        """found (distinct grams, stored) plus `logs`: the log-probability of the last symbol, for every class."""
        parts = [found.select("gram")]
        for order in range(ORDER - 1, 0, -1):
            parts.append(stored(parts[-1].select(_lower(order).alias("gram")).distinct(), "parts"))
        n = range(len(self.classes))
        below = None
        for order, wanted in enumerate(parts[::-1], 1):
            wanted = wanted.join(self.alphas[order - 1], "gram", "left")
            wanted = wanted.withColumn("context", F.shiftright("gram", SYMBOL_BITS)).join(self.gammas[order - 1], "context", "left")
            if below is not None:
                wanted = wanted.withColumn("lower", _lower(order - 1)).join(below, "lower")
            rest = [F.lit(1.0 / SYMBOLS) if below is None else F.col("p")[i] for i in n]
            # An unknown gram has no alpha; an unknown context leaves everything to the lower order.
            p = F.array(*[F.coalesce(F.col("alpha")[i], F.lit(0.0)) + F.coalesce(F.col("gamma")[i], F.lit(1.0)) * rest[i] for i in n])
            below = wanted.select(F.col("gram").alias("lower"), p.alias("p"))
        logs = F.transform("p", lambda x: F.log(x)).alias("logs")
        return found.join(below.select(F.col("lower").alias("gram"), logs), "gram")

    def add_totals(self, df: DataFrame, text_column: str, name: str) -> DataFrame:
        """df (stored on the way) plus `name`: struct of sums, the log-probability of the text under each class, and chars."""
        uid, more = (free_name(df.withColumn(name, F.lit(None)), c) for c in ("uid", "more"))
        rows = stored(df.withColumn(uid, F.monotonically_increasing_id()), "texts")
        texts = rows.where(F.col(text_column).isNotNull()).select(F.lit("").alias("class"), F.col(text_column).cast("string").alias("text"))
        found = count_grams(texts, self.alphabet)
        # Grams are kept by how often they stand in these texts, so none that is left for the join is a frequent key.
        kept = _kept(found, self.entries)
        priced = stored(self.priced(found.select("gram", kept.alias("kept"))), "prices")
        table = priced.where("kept").select("gram", "logs").toArrow()
        logs = table.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, len(self.classes))
        held = HashArray(table.column("gram").to_numpy().view(np.uint64), logs)
        shared = df.sparkSession.sparkContext.broadcast((self.alphabet, held))  # bounded by `entries`

        @F.arrow_udf("sums array<double>, chars long, rest array<long>")
        def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            alphabet, held = shared.value
            for texts in columns:
                yield _known(alphabet, held, texts)

        out = bounded_batches(rows).withColumn(name, known(F.col(text_column).cast("string")))
        out = stored(out, "known")
        left = out.select(uid, F.explode(f"{name}.rest").alias("gram")).join(priced.where("NOT kept").select("gram", "logs"), "gram")
        left = left.groupBy(uid).agg(F.array(*[F.sum(F.col("logs")[i]) for i in range(len(self.classes))]).alias(more))
        sums = F.zip_with(F.col(f"{name}.sums"), F.col(more), lambda a, b: a + b)
        joined = out.join(left, uid, "left")
        sums = F.when(F.col(more).isNull(), F.col(f"{name}.sums")).otherwise(sums)
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(sums.alias("sums"), F.col(f"{name}.chars").alias("chars")).alias(name))


def _lower(order: int) -> Column:
    """The last `order` symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * order)) - 1))


def _known(alphabet: Alphabet, held: HashArray, texts: pa.Array) -> pa.Array:
    """Of each text the sums over its grams that are in `held`, its characters, and the grams that are not."""
    sums, sizes, rests = [], [], []
    for low, high in slices(texts, _SCORED_BYTES):
        found, lengths = grams(texts.slice(low, high - low), alphabet)
        at = held.find(found) if len(held.rows) else np.full(len(found), -1, np.int64)
        scores = np.zeros((len(found) + 1, held.rows.shape[1]))
        scores[1:][at >= 0] = held.rows[at[at >= 0]]
        scores = np.cumsum(scores, axis=0)
        ends = np.cumsum(lengths)
        sums.append(scores[ends] - scores[ends - lengths])
        sizes.append(lengths)
        missing = np.concatenate([[0], np.cumsum(at < 0)])
        part = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], missing[ends]]), pa.int32()), pa.array(found[at < 0].view(np.int64)))
        rests.append(part)
    n = held.rows.shape[1]
    flat = np.concatenate([np.zeros((0, n)), *sums])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * n, pa.int32()), pa.array(flat.ravel()))
    columns = [lists, pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])), pa.concat_arrays([pa.array([], pa.list_(pa.int64())), *rests])]
    return pa.StructArray.from_arrays(columns, ["sums", "chars", "rest"])


def totals(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-probabilities of each text under each class, and the texts' lengths in characters."""
    sums, sizes = [np.zeros((0, len(model.classes)))], [np.zeros(0, np.int64)]
    for low, high in slices(texts, _SCORED_BYTES):
        found, lengths = grams(texts.slice(low, high - low), model.alphabet)
        scores = np.zeros((len(found) + 1, len(model.classes)))
        np.cumsum(model.score(found), axis=0, dtype=np.float64, out=scores[1:])
        ends = np.cumsum(lengths)
        sums.append(scores[ends] - scores[ends - lengths])
        sizes.append(lengths)
    return np.concatenate(sums), np.concatenate(sizes)


def fit(df: DataFrame, kind: str, smoothing: str, classes: list[str], entries: int | None = ENTRIES) -> Model:
    """Model of the rows of df (class, text). At most `entries` grams and as many contexts come to the driver."""
    if not classes:
        return Model(classes, Alphabet(kind))  # nothing to learn from: every text scores alike
    alphabet = alphabet_of(df, kind)
    bound = None if entries is None else entries // (ORDER * len(classes))
    return _collected(_levels(count_grams(df, alphabet), smoothing), smoothing, Model(classes, alphabet), bound)


def fit_whole(df: DataFrame, kind: str, smoothing: str, classes: list[str], entries: int | None = ENTRIES) -> Model | Tables:
    """Model of the rows of df (class, text) with every gram: on the driver up to `entries` of them (None: always), else in tables."""
    if not classes:
        return Model(classes, Alphabet(kind))
    alphabet = alphabet_of(df, kind)
    levels = _levels(count_grams(df, alphabet), smoothing)
    if entries is None or sum(counts.count() for counts in levels) <= entries:
        return _collected(levels, smoothing, Model(classes, alphabet), None)
    alphas, gammas = [], []
    for counts in levels:
        weighted = stored(_weighted(counts, smoothing, F.lit(True)), "weights")

        def by_class(key: str, value: str) -> DataFrame:
            return weighted.groupBy(key).agg(F.array(*[F.max(F.when(F.col("class") == c, F.col(value))) for c in classes]).alias(value))

        alphas.append(stored(by_class("gram", "alpha"), "alphas"))
        gammas.append(stored(by_class("context", "gamma"), "gammas"))
    return Tables(classes, alphabet, alphas, gammas, entries)


def _collected(levels: list[DataFrame], smoothing: str, model: Model, bound: int | None) -> Model:
    """`model` with all orders; of each class and order `bound` grams at most."""
    index = {c: i for i, c in enumerate(model.classes)}
    for counts in levels:
        found = _weighted(counts, smoothing, _kept(counts, bound)).toArrow()
        of = np.array([index[c] for c in found.column("class").to_pylist()], np.int64)
        gram, context = (found.column(c).to_numpy().view(np.uint64) for c in ("gram", "context"))
        alpha, gamma = (found.column(c).to_numpy() for c in ("alpha", "gamma"))
        model.add((of, gram, alpha), (of, context, gamma))
    return model
