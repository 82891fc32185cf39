"""9. SentencePiece unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

White space is the marker U+2581, one of which stands before every text but the empty one. No piece holds a marker behind another
character, so words between single spaces are independent: each different one is worked on once a batch, many of
them in step. A character that no piece covers costs PENALTY more than the worst piece and comes out as its bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_output, tokens

MARKER = "▁"
PENALTY = 10.0
_open: dict[str, Unigram] = {}


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log scores for a vocabulary that orders its pieces by rank (0, -1, -2, ...): Zipf's law, by which frequency falls as 1 / rank."""
    ranks = 1.0 - scores.astype(np.float64)
    return (-np.log(ranks) - np.log(np.sum(1.0 / ranks))).astype(np.float32)


class DoubleArray:
    """A trie over bytes: from a state s, byte c leads to base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        nodes: list[dict[int, int]] = [{}]
        value = [-1]
        for k, key in enumerate(keys):
            at = 0
            for c in key:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    value.append(-1)
                at = nodes[at][c]
            value[at] = k
        # nodes with the most children are placed first, while there is room; those with one fill the gaps
        used = np.zeros(2 * len(nodes) + 1024, bool)
        used[0] = True
        bases = np.zeros(len(nodes), np.int64)
        low = 1
        for n in sorted(range(len(nodes)), key=lambda n: (-len(nodes[n]), n)):
            labels = np.array([c + 1 for c in nodes[n]], np.int64)
            if not len(labels):
                break
            while used[low]:
                low += 1
            # one child may stand at any slot from its label on, so that its base isn't negative
            at = max(0, low - int(labels.min()))
            while True:
                if at + 4096 + 258 > len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                fits = np.ones(4096, bool)
                for c in labels:
                    fits &= ~used[at + c : at + c + 4096]
                if fits.any():
                    break
                at += 4096
            bases[n] = at + int(fits.argmax())
            used[bases[n] + labels] = True
        state = np.zeros(len(nodes), np.int64)
        parent = np.zeros(len(nodes), np.int64)
        for n, children in enumerate(nodes):
            for c, child in children.items():
                state[child], parent[child] = bases[n] + c + 1, n
        size = int(max(state.max(), bases.max())) + 258
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[state], self.value[state] = bases, value
        self.check[state[1:]] = state[parent[1:]]


_PART = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+$")


class Unigram(tokens.WordTokenizer):
    """Encodes with the pieces of a SentencePiece model file, whatever kind of model it was made for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in normal]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece holds a marker behind another character: words aren't independent here")
        self.normal = np.array(normal, np.uint32)
        self.scores = log_scores(np.array([model.get_score(i) for i in normal]))
        self.unknown = np.float32(self.scores.min() - PENALTY)
        self.trie = DoubleArray([p.encode() for p in pieces])
        self.byte_ids = np.zeros(256, np.uint32)
        texts = [b""] * len(ids)
        for i, p in zip(normal, pieces, strict=True):
            texts[i] = p.encode()
        for i in ids:
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], texts[i] = i, bytes([value])
        self.is_byte = np.array([model.is_byte(i) for i in ids])
        self.piece_starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.before, self.heads, self.odd = MARKER, False, rf"^$|^ |  | $|{MARKER}"
        self._forget()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """A text of any length by its parts, each some markers and what follows them: no piece reaches into the next."""
        parts = [_PART.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        flat = [p for some in parts for p in some]
        ids: list[int] = []
        stops = [0]
        for a in range(0, len(flat), self.at_once):
            some, counts = self._new(flat[a : a + self.at_once])
            stops += (stops[-1] + np.cumsum(counts)).tolist()
            ids += some.tolist()
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return [ids[stops[a] : stops[b]] for a, b in zip([0, *ends], ends, strict=False)]

    def _new(self, words: list[str], spaced: bool = True) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        text = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(r) for r in raw], np.int64)
        begins = np.cumsum(lengths) - lengths
        ends_of = np.repeat(begins + lengths, lengths)
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        # all pieces from each character on: start, end, piece
        at, node, depth = starts, np.zeros(len(starts), np.int32), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            inside = at + depth < ends_of[at]
            at, node = at[inside], node[inside]
            target = self.trie.base[node] + text[at + depth].astype(np.int32) + 1
            good = self.trie.check[target] == node
            at, node = at[good], target[good]
            depth += 1
            value = self.trie.value[node]
            ends = np.flatnonzero(value >= 0)
            found.append((at[ends], at[ends] + depth, value[ends]))
        size = np.diff(np.append(starts, len(text)))
        covered = np.zeros(len(text) + 1, bool)
        char_end = np.zeros(len(text) + 1, np.int64)
        char_end[starts] = starts + size
        for s, e, _ in found:
            covered[s[char_end[s] == e]] = True
        lone = starts[~covered[starts]]
        found.append((lone, char_end[lone], np.full(len(lone), -1, np.int32)))
        s, e, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
        score = np.where(piece >= 0, self.scores[piece], self.unknown).astype(np.float32)
        # words in step, by the place of a piece's start in its word; the places of a word after another's end don't meet
        word = np.repeat(np.arange(len(words)), lengths)
        place = s - begins[word[s]]
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(int(place.max(initial=-1)) + 2))
        # a slot more than bytes for each word, so that a word's end isn't the next one's start
        shift = word[s]
        s_slot, e_slot = (s + shift)[order], (e + shift)[order]
        piece, score = piece[order], score[order]
        best = np.full(len(text) + len(words), -np.inf, np.float32)
        best[begins + np.arange(len(words))] = 0
        back = np.zeros(len(best), np.int64)
        chosen = np.full(len(best), -1, np.int32)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            total = best[s_slot[a:b]] + score[a:b]
            better = total > best[e_slot[a:b]]
            to = e_slot[a:b][better]
            best[to], back[to], chosen[to] = total[better], s_slot[a:b][better], piece[a:b][better]
        # backwards from the ends
        first = begins + np.arange(len(words))
        which = np.flatnonzero(lengths > 0)
        now = (first + lengths)[which]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            parts.append((which, back[now], chosen[now]))
            now = back[now]
            more = now > first[which]
            which, now = which[more], now[more]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        which, begin, piece = (np.concatenate([p[k] for p in parts[::-1]]) for k in range(3))
        order = np.argsort(begin, kind="stable")
        which, begin, piece = which[order], begin[order] - which[order], piece[order]
        width = np.where(piece >= 0, 1, char_end[begin] - begin)
        ids = np.repeat(np.where(piece >= 0, self.normal[piece], 0).astype(np.uint32), width)
        lone = np.repeat(piece < 0, width)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
        ids[lone] = self.byte_ids[text[(np.repeat(begin, width) + offset)[lone]]]
        return ids, np.bincount(which, weights=width, minlength=len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8, as far as bytes that pieces give are UTF-8."""
        starts = self.piece_starts[ids]
        width = self.piece_starts[ids.astype(np.int64) + 1] - starts
        where = np.arange(int(width.sum())) + np.repeat(starts - (np.cumsum(width) - width), width)
        return self.piece_bytes[where].tobytes().replace(MARKER.encode(), b" ")[1:]


def _coded(path: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _open:
        _open[path] = Unigram(path)
    tool = _open[path]
    for batch in batches:
        texts = batch.column("text")
        for a, ids, counts in tool.encode(texts):
            rows = []
            for k, one in enumerate(np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])):
                original = (texts[a + k].as_py() or "").encode()
                rows.append((len(one), int(tool.is_byte[one].sum()), zlib.crc32(one.tobytes()), tool.decode(one) == original, *([one] if with_ids else [])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(4 + with_ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(rows)), *columns], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "ids"][: 5 + with_ids])


def encoded(docs: DataFrame, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip and ids of each row of ``docs`` (doc_id, text; other columns are left out).

    round_trip: whether the decoded ids are the text; they aren't where it holds the marker itself, which becomes a
    space. A null text is an empty one, without ids. Rows that repeat get equal results; a text of any length is encoded
    as a whole; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"
    return rows.mapInArrow(lambda b: _coded(path, with_ids, b), schema + ", ids array<long>" * with_ids)


def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.load(spark, sf_dir, "documents"), token_output.vocabulary("piece_bpe_32k.model"), with_ids=False)
