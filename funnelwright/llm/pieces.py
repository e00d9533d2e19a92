"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding is the agenda of a SentencePiece BPE model: of all candidate merges of neighbouring symbols the one with the best
score (then the leftmost) is taken next. With dropout, a candidate is skipped when its keyed hash falls below the rate.
The key is the seed, a variant number, the unit's bytes and the place of both symbols, so a segmentation depends on nothing
but those: the same on every run, partition and retry. The variant of a unit is a keyed hash of the text's key and the
unit's number, modulo `VARIANTS`, so a word is cut in varied ways across and within texts, and each of its cuts is
computed once per batch of work.

A unit is a run of blanks with the word behind it: pieces of such a model never hold a blank after another character, so
no merge crosses a unit. The symbols of a unit are a linked list that keeps its places, so a merge touches its two
neighbours and moves nothing. Many units of one length take their merges side by side in arrays, one each per round; a
long unit, or one of a rare length, has a heap for its agenda. Both follow the same order and the same keyed hash.

Characters that the model does not know become byte pieces; so does its blank sign when it stands in a text, which is why
decoding gives back exactly the text that was encoded, with or without dropout. The text is taken as it is: the model must
not normalise (that is checked).

Defined cases: null gives null; the empty text gives no ids; very long texts are cut at units, which changes nothing; ties
cannot remain (score, then place); repeated rows with equal keys get equal ids; an empty table gives an empty result.
Added columns take a leading underscore where the input already has their name.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from functools import cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, mix

SEED = 20240607
RATE = 0.1
VARIANTS = 8
# (variant, unit) cuts held in a worker: twice this number at most, and what one batch brings.
CACHED = 150_000
SIGN = "▁"
_UNITS = re.compile(r" *[^ ]+| +$")
_MUL = np.uint64(0x9E3779B97F4A7C15)
# Units of one length that are worth rounds in arrays, the longest such length, and array cells worked on at a time.
TOGETHER, ROUNDS, CELLS = 16, 64, 1 << 18
_GONE, _FREE = -2, -2
# A turn on the agenda: rank, then place in the low bits.
_PLACES, _NEVER = 21, np.iinfo(np.int64).max


def _mixed(x: int) -> int:
    """`mix` of one number."""
    full = (1 << 64) - 1
    x &= full
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ x >> 27) * 0x94D049BB133111EB & full
    return x ^ x >> 31


class PieceModel:
    """Vocabulary and merge table of a SentencePiece BPE model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if model.encode("ﬁ  a", out_type=str)[-2:] != [SIGN * 2 if model.piece_to_id(SIGN * 2) != model.unk_id() else SIGN, "a"] and "ﬁ" not in model.decode(
            model.encode("ﬁ  a")
        ):
            raise ValueError("the model normalises its input")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        names = [model.id_to_piece(i) for i in range(n)]
        usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        ids = {name: i for i, name in enumerate(names) if usable[i]}
        # Texts keep their blanks here; the sign stands for them in the vocabulary only.
        self.symbols = {name.replace(SIGN, " "): i for name, i in ids.items() if len(name) == 1}
        keys, results = [], []
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = ids.get(name[:cut]), ids.get(name[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    results.append(i)
        self.size = n
        self.pairs = dict(zip(keys, results, strict=True))
        self._fill(np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32))
        # A literal sign must not pass for a blank: it is unknown here, and goes out as bytes.
        self.of_code = np.full(sys.maxunicode + 1, -1, np.int32)
        self.of_code[[ord(c) for c in self.symbols if c != SIGN]] = [i for c, i in self.symbols.items() if c != SIGN]
        # Rank of a piece: 0 is merged first. Scores of BPE models fall from piece to piece.
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.searchsorted(np.sort(-scores), -scores).astype(np.int32)
        self.bytes = [
            bytes([self.byte_ids.index(i)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(SIGN, " ").encode() for i in range(n)
        ]
        self.spelled = pa.array(self.bytes, pa.large_binary())
        self.held: list[dict] = [{}, {}]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two neighbours make, or -1."""
        wanted = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.size + right)
        slot = self._slot(wanted)
        there = self.table[slot]
        out = np.where(there == wanted, self.made[slot], -1)
        open_ = np.flatnonzero((there != wanted) & (there != _FREE))
        while len(open_):
            slot = (slot if len(slot) == len(open_) else slot[open_]) + 1 & len(self.table) - 1
            own = wanted[open_]
            there = self.table[slot]
            out[open_] = np.where(there == own, self.made[slot], -1)
            more = (there != own) & (there != _FREE)
            open_, slot = open_[more], slot[more]
        return out

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * _MUL >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _fill(self, pairs: np.ndarray, results: np.ndarray) -> None:
        """Hash table of the merges with open addresses, a quarter full at most."""
        self.table = np.full(1 << (4 * len(pairs) + 4).bit_length(), _FREE, np.int64)
        self.made = np.full(len(self.table), -1, np.int32)
        slot = self._slot(pairs)
        while len(pairs):
            free = np.flatnonzero(self.table[slot] == _FREE)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.table[slot[taken]], self.made[slot[taken]] = pairs[taken], results[taken]
            rest = np.ones(len(pairs), bool)
            rest[taken] = False
            pairs, results, slot = pairs[rest], results[rest], slot[rest] + 1 & len(self.table) - 1

    def cut(self, units: list[str], variants: np.ndarray, seed: int, rate: float) -> list[bytes]:
        """Ids of each unit under its variant, 4 bytes each."""
        out = [b""] * len(units)
        lengths = np.array([len(u) for u in units])
        order = np.argsort(lengths, kind="stable")
        limit = np.uint64(min(max(rate, 0.0), 1.0) * (2**64 - 1)) if rate < 1 else np.uint64(2**64 - 1)
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = int(lengths[rows[0]]) if len(rows) else 0
            step = max(1, CELLS // max(length, 1))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                own = [units[i] for i in part.tolist()]
                codes = np.ascontiguousarray(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), length).T)
                unit_key = mix(variants[part].astype(np.uint64) * _MUL + np.uint64(seed))
                for i in range(length):
                    unit_key = mix(unit_key ^ codes[i].astype(np.uint64))
                ids = self.of_code[codes]
                if len(own) >= TOGETHER and length <= ROUNDS:
                    ids = self._rounds(ids, unit_key, limit, rate > 0)
                else:
                    ids = np.stack([self._agenda(ids[:, i], unit_key[i], limit, rate > 0) for i in range(len(own))], axis=1)
                for i, found in zip(part.tolist(), self._packed(own, ids.T), strict=True):
                    out[i] = found
        return out

    def _packed(self, units: list[str], ids: np.ndarray) -> list[bytes]:
        """Ids that are left of each unit; characters without a piece become bytes."""
        left = ids != _GONE
        flat = ids[left].astype(np.int32).tobytes()
        ends = np.cumsum(4 * left.sum(axis=1)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero((ids == -1).any(axis=1)).tolist():
            found: list[int] = []
            for place, x in enumerate(ids[i].tolist()):
                if x != _GONE:
                    found += [x] if x >= 0 else [self.byte_ids[b] for b in units[i][place].encode()]
            out[i] = np.array(found, np.int32).tobytes()
        return out

    def _candidates(
        self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, end: np.ndarray, unit_key: np.ndarray, limit: np.uint64, drop: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        """Piece of merging symbols a and b, which start at left and right and end at end, and its place on the agenda."""
        piece = self.merged(a, b)
        turn = np.where(piece >= 0, (self.rank[piece].astype(np.int64) << _PLACES) | left, _NEVER)
        if drop:
            some = np.flatnonzero(piece >= 0)
            place = (left[some].astype(np.uint64) << np.uint64(42)) | (right[some].astype(np.uint64) << np.uint64(21)) | end[some].astype(np.uint64)
            turn[some[mix(unit_key[some] ^ mix(place)) < limit]] = _NEVER
        return piece, turn

    def _rounds(self, ids: np.ndarray, unit_key: np.ndarray, limit: np.uint64, drop: bool) -> np.ndarray:
        """Merges of units of one length, a column each: every round takes the next merge of each unit that has one."""
        length, n = ids.shape
        done, column = ids.copy(), np.arange(n)
        places = np.arange(length + 1, dtype=np.int64)[:, None]
        following, before = np.repeat(places[1:], n, axis=1), np.repeat(places - 1, n, axis=1)
        made, turn = np.full((length, n), -1, np.int32), np.full((length, n), _NEVER, np.int64)
        for i in range(length - 1):
            at = np.full(n, i)
            made[i], turn[i] = self._candidates(ids[i], ids[i + 1], at, at + 1, at + 2, unit_key, limit, drop)
        while True:
            best = turn.min(axis=0)
            go = np.flatnonzero(best != _NEVER)
            if 4 * len(go) < 3 * len(best):
                done[:, column] = ids
                column, unit_key, best = column[go], unit_key[go], best[go]
                ids, following, before, made, turn = (x[:, go] for x in (ids, following, before, made, turn))
                go = np.arange(len(go))
            if not len(go):
                break
            at = best[go] & (1 << _PLACES) - 1
            right = following[at, go]
            end = following[right, go]
            piece = made[at, go]
            ids[at, go], ids[right, go] = piece, _GONE
            following[at, go], before[end, go] = end, at
            turn[right, go] = _NEVER
            left = before[at, go]
            some = np.flatnonzero(left >= 0)
            own, l = go[some], left[some]
            made[l, own], turn[l, own] = self._candidates(ids[l, own], piece[some], l, at[some], end[some], unit_key[own], limit, drop)
            turn[at, go] = _NEVER
            some = np.flatnonzero(end < length)
            own, a, e = go[some], at[some], end[some]
            made[a, own], turn[a, own] = self._candidates(piece[some], ids[e, own], a, e, following[e, own], unit_key[own], limit, drop)
        done[:, column] = ids
        return done

    def _agenda(self, symbols: np.ndarray, unit_key: np.uint64, limit: np.uint64, drop: bool) -> np.ndarray:
        """Merges of one unit by a heap: work follows the number of merges, however long the unit."""
        n = len(symbols)
        at = np.arange(n, dtype=np.int64)
        piece, turn = self._candidates(symbols[:-1], symbols[1:], at[:-1], at[:-1] + 1, at[:-1] + 2, np.full(max(n - 1, 0), unit_key), limit, drop)
        some = np.flatnonzero(turn != _NEVER).tolist()
        # A symbol that is merged or grown has another end: an entry counts while both of its symbols are as they were.
        heap = [(int(self.rank[piece[i]]), i, i + 1, i + 2, int(piece[i])) for i in some]
        heapq.heapify(heap)
        ids, following, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n))
        key, bar = int(unit_key), int(limit)

        def propose(left: int, right: int, end: int) -> None:
            if ids[left] < 0 or ids[right] < 0:
                return
            found = self.pairs.get(ids[left] * self.size + ids[right])
            if found is not None and not (drop and _mixed(key ^ _mixed(left << 42 | right << 21 | end)) < bar):
                heapq.heappush(heap, (int(self.rank[found]), left, right, end, found))

        while heap:
            _, left, right, end, found = heapq.heappop(heap)
            if ids[left] == _GONE or following[left] != right or ids[right] == _GONE or following[right] != end:
                continue
            ids[left], ids[right] = found, _GONE
            following[left], before[end] = end, left
            if before[left] >= 0:
                propose(before[left], left, end)
            if end < n:
                propose(left, end, following[end])
        return np.array(ids, np.int32)

    def encode(self, texts: list[str | None], keys: np.ndarray, seed: int, rate: float, variants: int) -> list[np.ndarray | None]:
        """Ids of each text; keys: an unsigned 64-bit number for each."""
        if len(self.held[0]) > CACHED:
            self.held = [{}, self.held[0]]
        now, before = self.held
        texts_units: list[list[str] | None] = []
        wanted: set[str] = set()
        for i, text in enumerate(texts):
            own = None
            if text is not None:
                own = _UNITS.findall(" " + text) if text else []
                drawn = mix(mix(np.arange(len(own), dtype=np.uint64) * _MUL + np.uint64(seed)) ^ keys[i]) % np.uint64(variants if rate > 0 else 1)
                # A variant goes before its unit as one character: a string is hashed once, a pair each time.
                own = list(map(add, map(chr, drawn.tolist()), own))
                wanted.update(own)
            texts_units.append(own)
        missing = []
        for x in wanted.difference(now):
            known = before.get(x)
            if known is None:
                missing.append(x)
            else:
                now[x] = known
        if missing:
            found = self.cut([x[1:] for x in missing], np.array([ord(x[0]) for x in missing]), seed, rate)
            now.update(zip(missing, found, strict=True))
        return [None if own is None else np.frombuffer(b"".join(map(now.__getitem__, own)), np.int32) for own in texts_units]

    def decode(self, ids: list[int]) -> str:
        """The text, without the blank that encoding puts before it."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        """`decode` of each list of ids, all in one array; null gives null."""
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
        _, offsets, data = self.spelled.take(rows.flatten()).buffers()
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        ends = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(lengths)])]
        some = np.diff(ends) > 0
        data = np.delete(data[: ends[-1]], ends[:-1][some])
        ends = ends - np.concatenate([[0], np.cumsum(some)])
        found = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            texts = found.cast(pa.string())
        except pa.ArrowInvalid:  # ids that make no whole characters
            texts = pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())
        return pc.if_else(rows.is_valid(), texts, pa.scalar(None, pa.string()))


@cache
def piece_model(path: str) -> PieceModel:
    """One per Python worker."""
    return PieceModel(path)


def encode(
    df: DataFrame,
    model: str,
    key_column: str = "doc_id",
    text_column: str = "text",
    seed: int = SEED,
    rate: float = RATE,
    variants: int = VARIANTS,
) -> DataFrame:
    """df plus ids: array<int>, the pieces of the whole text."""
    if not 0 <= rate <= 1 or not 1 <= variants <= sys.maxunicode:
        raise ValueError("a rate from 0 to 1, and variants from 1 to the number of characters")

    @F.arrow_udf("array<int>")
    def pieces_of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = piece_model(model)
        for texts, keys in columns:
            numbers = keys.to_numpy().view(np.uint64)
            lists = own.encode(texts.to_pylist(), numbers, seed, rate, variants)
            ends = np.cumsum([0] + [0 if x is None else len(x) for x in lists])
            flat = np.concatenate([np.zeros(0, np.int32), *[x for x in lists if x is not None]])
            missing = pa.array([x is None for x in lists])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=missing)

    return bounded_batches(df).withColumn(free_name(df, "ids"), pieces_of(F.col(text_column).cast("string"), F.xxhash64(F.col(key_column))))


def decoded(ids: Column, model: str) -> Column:
    """Text of an array of ids; null gives null."""

    @F.arrow_udf("string")
    def text_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = piece_model(model)
        for rows in columns:
            yield own.decode_all(rows)

    return text_of(ids)
