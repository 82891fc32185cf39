"""Ids of the tokenizers library for whole columns of texts, each different word tokenised once per batch.

Both pre-tokenizers used here start a new piece at a space between two characters that are not white space, so
a text's ids are those of its space-separated words in turn, each with its leading space. Texts with any other
use of spaces go through the library whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are split together up to so many bytes, and their ids are handed out about so many at a time.
GROUP_BYTES, SLICE_IDS = 12 << 20, 1 << 20
#: New words that go through the library as one text.
TOGETHER = 128
#: Different words that a worker remembers at least; those of the so many before are kept where they were used again.
REMEMBER = 150_000
#: Without leading spaces, a word of letters below U+0250 and one of these signs behind it are a piece each.
_SIGNS = frozenset(".,;:!?")
_SIMPLE = "\u0250"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Stands between words that go through the library together; texts that hold it go through alone.
_MARK = "\x01"
_ODD = rf"(^|{_BLANK}) | ({_BLANK}|$)|{_MARK}"
#: How byte-level vocabularies write bytes that aren't printed as themselves: as the characters from U+0100 on, in turn.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_open: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """One of each file in a worker. spaced: whether a leading space is part of a word's tokens."""
    if (path, spaced) not in _open:
        _open[path, spaced] = WordTokenizer(path, spaced)
    return _open[path, spaced]


class WordTokenizer:
    #: New words that are worked on at once.
    at_once = 16384

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_file(path)
        self.before, self.heads, self.odd = " " if spaced else "", spaced, _ODD
        if spaced:
            size = self.library.get_vocab_size()
            self.begins = np.fromiter((self.library.id_to_token(i).startswith("\u0120") for i in range(size)), bool, size)
        else:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            (self.mark,) = self.library.encode(_MARK, add_special_tokens=False).ids
        self._forget()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts on their own."""
        return [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Begins to remember anew; what was remembered stays at hand until the next time."""
        self.old = (self.known, self.flat, self.starts) if hasattr(self, "known") else ({}, np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.stems: dict[str, list[int]] = {}
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.words = self.used = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Appends words' ids; the index of the first."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.words + len(counts) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.words + 1 : self.words + len(counts) + 1] = self.used + np.cumsum(counts)
        at = self.words
        self.words += len(counts)
        self.used += len(ids)
        return at

    def _stem(self, stem: str) -> list[int]:
        """Ids of a piece of letters, or of a sign."""
        plain = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_BYTES)
        self.stems[stem] = ids = [t.id for t in self.library.model.tokenize(plain)]
        return ids

    def _simple(self, words: list[str]) -> tuple[list[list[int]], list[int]]:
        """Ids of words without a space that are letters and perhaps a sign, or empty; and where others stand."""
        out: list[list[int]] = []
        others: list[int] = []
        stems = self.stems
        for k, word in enumerate(map(str.lower, words)):
            sign = word[-1] if word and word[-1] in _SIGNS else ""
            stem = word[:-1] if sign else word
            if stem.isalpha() and (stem.isascii() or max(stem) < _SIMPLE):
                ids = stems.get(stem) or self._stem(stem)
                out.append(ids + (stems.get(sign) or self._stem(sign)) if sign else ids)
            else:
                out.append([])
                if word:
                    others.append(k)
        return out, others

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that all begin with a space or of which none holds one, and how many each has: from the library, as one text."""
        if self.before:
            ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
        text = f" {_MARK} ".join(words)
        # the normalizer's work on these characters is lower case alone; words are apart already
        tool, text = (self.plain, text.lower()) if text.isascii() or max(text) < _SIMPLE else (self.library, text)
        ids = np.array(tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = ids == self.mark
        return ids[~marks], np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])) - 1

    def _checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self._joined(words)
        if len(counts) != len(words):
            raise ValueError("this tokenizer joins words across spaces")
        return ids, counts

    def _new(self, words: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        if spaced and self.before:
            # all from the library, in order: they stay numbers
            parts = [self._checked(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])
        each, others = self._simple(words) if spaced else (self._whole(words), [])
        for a in range(0, len(others), TOGETHER):
            some = others[a : a + TOGETHER]
            ids, counts = self._checked([words[k] for k in some])
            flat, stops = ids.tolist(), np.cumsum(counts).tolist()
            for k, start, stop in zip(some, [0, *stops], stops, strict=False):
                each[k] = flat[start:stop]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(counts.sum())), counts

    def _indices(self, keys: list[str], spaced: bool = True) -> np.ndarray:
        """Where the keys' ids are; those not seen before are looked up in what was remembered before, and else made."""
        get = self.known.get
        found = np.array([get(k, -1) for k in keys], np.int32)
        new = np.flatnonzero(found < 0)
        missing = [keys[i] for i in new.tolist()]
        known, flat, starts = self.old
        before = np.array([known.get(k, -1) for k in missing], np.int64)
        again = before >= 0
        if again.any():
            at = before[again]
            counts = starts[at + 1] - starts[at]
            places = np.arange(counts.sum()) + np.repeat(starts[at] - (np.cumsum(counts) - counts), counts)
            found[new[again]] = self._remember([k for k, a in zip(missing, again.tolist(), strict=True) if a], flat[places], counts)
            missing = [k for k, a in zip(missing, again.tolist(), strict=True) if not a]
        places = new[~again]
        for a in range(0, len(missing), self.at_once):
            some = missing[a : a + self.at_once]
            found[places[a : a + len(some)]] = self._remember(some, *self._new(some, spaced))
        return found

    def _remember(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = self._add(ids, counts)
        self.known.update(zip(keys, range(at, at + len(keys)), strict=True))
        return np.arange(at, at + len(keys))

    def _encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(self.known) > REMEMBER:
            self._forget()
        odd = pc.match_substring_regex(column, self.odd)
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd_rows):
            whole = self._whole([column[int(i)].as_py() for i in odd_rows])
            column = pc.if_else(odd, "", column)
        parts = pc.split_pattern(column, " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        first = bounds[:-1]
        flat = parts.flatten()
        words = flat.dictionary_encode()
        keys = words.dictionary.to_pylist()
        of = self._indices([self.before + w for w in keys] if self.before else keys)[words.indices.to_numpy()]
        if self.heads:
            heads = flat.take(pa.array(first)).dictionary_encode()
            of[first] = self._indices(heads.dictionary.to_pylist(), False)[heads.indices.to_numpy()]
        if len(odd_rows):
            counts = np.array([len(x) for x in whole], np.int64)
            at = self._add(np.concatenate([np.array(x, np.uint32) for x in whole]), counts)
            of[first[odd_rows]] = np.arange(at, at + len(odd_rows))
        lengths = np.diff(self.starts[: self.words + 1]).astype(np.int32)
        before = np.zeros(len(of) + 1, np.int64)
        np.cumsum(lengths[of], out=before[1:])
        starts, totals = self.starts.astype(np.int32), before[bounds]
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(totals, totals[a] + SLICE_IDS, side="right")) - 1)
            some = of[bounds[a] : bounds[b]]
            n, low = lengths[some], totals[a]
            shift = starts[some] - (before[bounds[a] : bounds[b]] - low).astype(np.int32)
            where = np.repeat(shift, n)
            where += np.arange(len(where), dtype=np.int32)
            yield a, self.flat[where], np.diff(totals[a : b + 1])
            a = b

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows one after another, how many each row has); null is an empty text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(column):
            past = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + GROUP_BYTES, side="right"))
            b = max(a + 1, past)
            for at, ids, counts in self._encode(column.slice(a, b - a)):
                yield a + at, ids, counts
            a = b


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by the id ``end``; how many each row then has."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, end), counts + 1
