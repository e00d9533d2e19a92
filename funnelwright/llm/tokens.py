"""Token ids of whole texts by a public tokenizer, word by word with a bounded cache."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

# Words held twice over at most: recent ones, and those before them. A word takes about 40 bytes with its ids.
CACHED = 1 << 18
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Sorts of words: lower-case ASCII letters, letters, and others.
PLAIN, LETTERS, OTHER = 2, 1, 0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words that lie one after the other in `data`, by their places (n + 1)."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


class _Held:
    """Words, and numbers of each (ids or bytes) that lie one after the other."""

    def __init__(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.words, self.ids, self.ends = words, ids, ends

    def __len__(self) -> int:
        return len(self.words)

    def spans(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of these stretches, one after the other, and their places there."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def take(self, at: np.ndarray) -> _Held:
        return _Held(self.words.take(pa.array(at)), *self.spans(self.ends[at], np.diff(self.ends)[at]))

    def joined(self, others: list[_Held]) -> _Held:
        every = [self, *others]
        ends = np.cumsum([0] + [len(x.ids) for x in every])
        return _Held(
            pa.concat_arrays([x.words for x in every]),
            np.concatenate([x.ids for x in every]),
            np.concatenate([[0], *[low + x.ends[1:] for low, x in zip(ends[:-1], every, strict=True)]]),
        )


class WordTokenizer:
    """Ids as a `tokenizers` file gives them for the whole text.

    Holds for tokenizers that never join text across ASCII white space and drop that space, such as the one with word
    ends: then a text's ids are the ids of its words, and a word is encoded once while it stays in the cache. Where the
    tokenizer also parts letters from the signs behind them, a word with such signs is put together from both.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        upper = "".join(map(chr, range(65, 91)))
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str(upper) == upper.lower()
        # Signs that stay apart from any letter before them, and stand in no token that is looked for in the raw text.
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.signs = "".join(s for s in SIGNS if s not in added and self._parted(s)).encode()
        # Ids of tokens that end a run; there are such where the model marks word ends.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.plain = self._plain(added)
        self.forget()

    def _parted(self, sign: str) -> bool:
        split = self.tokenizer.pre_tokenizer
        letters = map(chr, [*range(65, 91), *range(97, 123)])
        return split is not None and all([at for _, at in split.pre_tokenize_str(c + sign)] == [(0, 1), (1, 2)] for c in letters)

    def _plain(self, added: str) -> bool:
        """Do words of lower-case ASCII letters reach the model as they are?"""
        normalizer, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = [chr(i) for i in range(97, 123)]
        words = [a + b for a in letters for b in letters] + letters + ["".join(letters) * 2]
        text = " ".join(words)
        return (
            split is not None
            and (normalizer is None or normalizer.normalize_str(text) == text)
            and all(split.pre_tokenize_str(w) == [(w, (0, len(w)))] for w in words)
            and not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        )

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """`encode` of each text; what is new in any of them goes to the tokenizer together."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[low:high].tobytes() for low, high in itertools.pairwise(ends.tolist())]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 places where they begin and end; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        at, own = words.indices.to_numpy(), self._ids(words.dictionary)
        ids, ends = own.spans(own.ends[at], np.diff(own.ends)[at])
        rows = split.offsets.to_numpy()
        return ids, ends[rows - rows[0]]

    def _ids(self, words: pa.Array) -> _Held:
        """Ids of different words."""
        # The tokenizer may ignore case: then words of ASCII characters are looked up in lower case.
        if self.lower:
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        data, offsets = utf8(words)
        stem = pc.binary_length(pc.ascii_rtrim(words, self.signs.decode())).to_numpy().astype(np.int64)
        size = np.diff(offsets)
        signed = (stem > 0) & (stem < size)
        signed[signed] = _LETTER[data[(offsets[:-1] + stem - 1)[signed]]]
        stem = np.where(signed, stem, size)
        whole = _Held(words, data, offsets)
        parts = [whole.spans(offsets[:-1], stem), whole.spans(offsets[:-1] + stem, size - stem)]
        parts = pa.concat_arrays([_strings(*part) for part in parts]).dictionary_encode()
        both = parts.indices.to_numpy().reshape(2, -1).T.ravel()  # each word's stem, then what follows it
        held = self._known(parts.dictionary).take(both)
        return _Held(words, held.ids, held.ends[::2])

    def forget(self) -> None:
        """Let go of all words: a Python worker lives on beside the stages that follow."""
        self.new = self.old = _Held(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def _known(self, words: pa.Array) -> _Held:
        """The words with their ids; from now on they are recent."""
        if len(self.new) > CACHED:
            self.old, self.new = self.new, self.old.take(np.zeros(0, np.int64))
        at = pc.index_in(words, self.new.words)
        missing = words.filter(at.is_null())
        before = pc.index_in(missing, self.old.words)
        again = self.old.take(before.drop_null().to_numpy())
        added = again.joined(list(self._learn(missing.filter(before.is_null()).to_pylist())))
        at = pc.replace_with_mask(at, at.is_null(), pc.add(pc.index_in(missing, added.words), len(self.new)).cast(pa.int32()))
        self.new = self.new.joined([added])
        return self.new.take(at.to_numpy())

    def _learn(self, words: list[str]) -> Iterator[_Held]:
        # Many words are encoded as one text.
        sorts: dict[int, list[str]] = {PLAIN: [], LETTERS: [], OTHER: []}
        for word in words:
            plain = self.plain and word.isascii() and word.islower()
            sorts[OTHER if not word.isalpha() else PLAIN if plain else LETTERS].append(word)
        for kind, own in sorts.items():
            for low in range(0, len(own), 4096):
                part = own[low : low + 4096]
                ids, cuts = self._cut(part, kind)
                yield _Held(pa.array(part, pa.string()), np.frombuffer(ids, "<u4"), np.array(cuts) // 4)

    def _cut(self, words: list[str], kind: int) -> tuple[bytes, list[int]]:
        """Ids of the words, one after the other, and the bytes at which each begins and the last one ends."""
        if kind == PLAIN:
            encode, all_ids, all_cuts = self.tokenizer.model.tokenize, [], [0]
            for word in words:
                all_ids += [token.id for token in encode(word)]
                all_cuts.append(4 * len(all_ids))
            return np.array(all_ids, "<u4").tobytes(), all_cuts
        text = " ".join(words)
        if kind == LETTERS:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):  # every word of letters has one run at least, so here each has just one
                return ids.tobytes(), [0, *(4 * ends).tolist()]
        found = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.fromiter((first for first, _ in found.offsets), np.int64, len(found.offsets))
        cuts = 4 * np.searchsorted(at, np.cumsum([0] + [len(w) + 1 for w in words]))
        return np.array(found.ids, "<u4").tobytes(), cuts.tolist()


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)
