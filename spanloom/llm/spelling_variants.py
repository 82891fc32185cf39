"""13. Spelling variants: words that differ in one code point, found in a trie of letter-group counts.

1. Words are counted document by document, then by Spark.
2. Letters are dealt into groups, and a word is arranged by its length and then by how often each group occurs in it:
   its path in the trie. An edit adds one to a count, takes one from another, or both, so from a word's path a search
   may leave by one in surplus and one in deficit.
3. The top levels of that search are rows: a word is sent to each node that it can reach within its budget, and the
   nodes' words meet it there. How many levels that are follows from the number of words, so that a node's words fit
   into a task; fuller ones are dealt into blocks.
4. Below, a task searches depth first, a stack of pairs of nodes at a time, with what is left of the budget; words at
   the leaves are verified. What leaves the task is a row for each word that was near another: how many, and the most
   frequent one.
5. Forms are followed to the last by joins of doubled length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checksums_sql, common

#: Code points and occurrences that a word has at least, and how many times as frequent its form is.
LENGTH, LEAST, RATIO = 6, 5, 5
#: The damage of the query: a run whose crc32 this divides loses a code point.
DIVISOR = 199
#: Groups of letters: a letter's code point modulo this. The commonest letters of Latin scripts are then apart.
GROUPS = 16
#: Words that a node of the top levels should hold, and that a block holds of the node's and of those that search there.
WORDS, BLOCK = 20_000, 40_000
#: Pairs of nodes, and bytes of pairs of words, that are worked on together.
_PAIRS, _BYTES = 1 << 15, 1 << 23
#: Different words that a task counts before it hands them on.
_HELD = 200_000

#: Latin-1 bytes: letters as lower case (of A-Z alone), all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Counter[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, in Latin-1. Characters beyond are no letters."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split(b" "))


def _counted(divisor: int | None, length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def taken() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])
            total.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                begun = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for run, n in runs(text).items():
                    # what is too short stays so
                    if len(run) < length:
                        continue
                    if divisor:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                        if h % divisor == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < length:
                                continue
                    total[run] += n
                if len(total) >= _HELD:
                    yield taken()
        yield taken()

    return count


def words(docs: DataFrame, divisor: int | None = None, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """code (Latin-1) and n of the words of docs (doc_id, text) that have ``length`` code points and occur ``least`` times; null and empty texts have none.

    divisor: where it divides the crc32 of ``doc_id:run``, the run loses the code point at that number modulo its
    length. A null doc_id is the empty string there.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted(divisor, length), "code binary, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _counts(codes: np.ndarray) -> np.ndarray:
    """Of words of one length (a row of bytes each), how often each group of letters occurs."""
    return np.stack([(codes % GROUPS == g).sum(1) for g in range(GROUPS)], axis=1).astype(np.int16) if len(codes) else np.zeros((0, GROUPS), np.int16)


def _rows(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1) if words else np.zeros((0, 1), np.uint8)


def _turns(depth: int, deficit: int) -> np.ndarray:
    """What a search may differ by in the counts of the first ``depth`` groups: one more once, and, if there is a deficit, one less once."""
    found = [np.zeros(depth, np.int16)]
    for g in range(depth):
        more = np.zeros(depth, np.int16)
        more[g] = 1
        found.append(more)
        if deficit:
            found.append(-more)
            found += [more - (np.arange(depth) == h) for h in range(depth) if h != g]
    return np.stack(found).astype(np.int16)


def _sent(depth: int, home: bool):
    """node, code, n: the node of the top levels that a word belongs to, or else all that it searches in: those of its length and of the next."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[tuple[bytes, int]]] = {}
            for code, n in zip(batch.column("code").to_pylist(), batch.column("n").to_pylist(), strict=True):
                by_length.setdefault(len(code), []).append((code, n))
            for length, found in by_length.items():
                counts = _counts(_rows([code for code, _ in found]))[:, :depth]
                own = [(length, np.zeros((1, depth), np.int16))]
                for size, turns in own if home else [(length, _turns(depth, 1)), (length + 1, _turns(depth, 0))]:
                    nodes = (counts[:, None] + turns[None]).astype(">i2")
                    who, which = np.nonzero((nodes >= 0).all(axis=2))
                    head = size.to_bytes(4, "big")
                    keys = [head + nodes[a, b].tobytes() for a, b in zip(who.tolist(), which.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([found[a][0] for a in who.tolist()], pa.binary()), pa.array([found[a][1] for a in who.tolist()], pa.int64())], names=["node", "code", "n"])

    return send


class _Trie:
    """Words of one length in the order of their counts: of each level the nodes' first children, and the counts that lead to them."""

    def __init__(self, words: list[bytes], n: list[int]):
        codes = _rows(words)
        counts = _counts(codes)
        order = np.lexsort((*codes.T[::-1], *counts.T[::-1])) if len(words) else np.zeros(0, np.int64)
        self.codes, self.n, counts = codes[order], np.array(n, np.int64)[order], counts[order]
        self.words = [words[k] for k in order]
        starts, new = np.zeros(min(1, len(words)), np.int64), np.zeros(len(words), bool)
        new[:1] = True
        self.first, self.count = [], []
        for level in range(GROUPS):
            new[1:] |= counts[1:, level] != counts[:-1, level]
            below = np.flatnonzero(new)
            self.first.append(np.append(np.searchsorted(below, starts), len(below)))
            self.count.append(counts[below, level])
            starts = below
        self.leaf = np.append(starts, len(words))


def _products(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of [a_lo, a_hi) and [b_lo, b_hi), row by row, and the row of each."""
    wide = b_hi - b_lo
    many = (a_hi - a_lo) * wide
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return a_lo[row] + at // wide[row], b_lo[row] + at % wide[row], row


def _pieces(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows whose weights add up to ``most`` or so."""
    ends = np.cumsum(weights)
    a = 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def _one_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y differ by one code point: replaced, or, where y is longer, inserted. Of equal lengths x must be the lesser."""
    if x.shape[1] == y.shape[1]:
        differ = x != y
        at = differ.argmax(1)
        k = np.arange(len(x))
        return (differ.sum(1) == 1) & (x[k, at] < y[k, at])
    before, after = x != y[:, :-1], x != y[:, 1:]
    length = x.shape[1]
    first = np.where(before.any(1), before.argmax(1), length)
    last = np.where(after.any(1), length - after[:, ::-1].argmax(1), 0)
    return last <= first


def _near(asked: _Trie, held: _Trie, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked word, held word) one apart: a depth-first search of both tries, by stacked chunks of pairs of nodes."""
    if not len(asked.n) or not len(held.n):
        return
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero, zero)]
    while stack:
        level, a, b, more, less = stack.pop()
        if level == GROUPS:
            for part in _pieces((asked.leaf[a + 1] - asked.leaf[a]), 1024):
                # a leaf's words against another's, some words of the former at a time
                x, k, _ = _products(asked.leaf[a[part]], asked.leaf[a[part] + 1], np.arange(len(a[part])), np.arange(len(a[part])) + 1)
                lo, hi = held.leaf[b[part]][k], held.leaf[b[part] + 1][k]
                for few in _pieces(hi - lo, max(1, _BYTES // held.codes.shape[1])):
                    u, v, _ = _products(x[few], x[few] + 1, lo[few], hi[few])
                    good = _one_apart(asked.codes[u], held.codes[v])
                    yield u[good], v[good]
            continue
        p, q, row = _products(asked.first[level][a], asked.first[level][a + 1], held.first[level][b], held.first[level][b + 1])
        change = held.count[level][q].astype(np.int64) - asked.count[level][p]
        more, less = more[row] + np.maximum(change, 0), less[row] + np.maximum(-change, 0)
        good = (more <= 1) & (less <= deficit)
        p, q, more, less = p[good], q[good], more[good], less[good]
        for k in range(0, len(p), _PAIRS):
            part = slice(k, k + _PAIRS)
            stack.append((level + 1, p[part], q[part], more[part], less[part]))


def _search(home: pa.Table, asked: pa.Table) -> pa.Table:
    """code, n_near, best_n, best of the words that are near one of the other side."""
    pairs_of = lambda t: list(zip(t.column("code").to_pylist(), t.column("n").to_pylist(), strict=True))
    here = pairs_of(home)
    length = len(here[0][0]) if here else 0
    held = _Trie([c for c, _ in here], [n for _, n in here])
    found: dict[bytes, list] = {}

    def take(word: bytes, other: bytes, n: int) -> None:
        have = found.setdefault(word, [0, n, other])
        have[0] += 1
        if (-n, other) < (-have[1], have[2]):
            have[1:] = n, other

    for size in (length, length - 1) if here else ():
        mine = [(c, n) for c, n in pairs_of(asked) if len(c) == size]
        trie = _Trie([c for c, _ in mine], [n for _, n in mine])
        for u, v in _near(trie, held, 1 if size == length else 0):
            for i, j in zip(u.tolist(), v.tolist(), strict=True):
                take(trie.words[i], held.words[j], int(held.n[j]))
                take(held.words[j], trie.words[i], int(trie.n[i]))
    values = list(found.values())
    return pa.table({"code": pa.array(list(found), pa.binary()), "n_near": pa.array([v[0] for v in values], pa.int64()), "best_n": pa.array([v[1] for v in values], pa.int64()), "best": pa.array([v[2] for v in values], pa.binary())})


def depth_for(n_words: int, words_a_node: int = WORDS) -> int:
    """Levels of groups that are searched by rows: lengths spread words over some nine nodes, a level over about three each."""
    return min(GROUPS, max(0, math.ceil(math.log(max(1, n_words / words_a_node / 9), 3))))


def near(found: DataFrame, depth: int, block: int = BLOCK) -> DataFrame:
    """code, n_near, best_n, best (the most frequent near word, ties to the least) of the words (code, n) that are near another."""
    sides = [found.mapInArrow(_sent(depth, home), "node binary, code binary, n long") for home in (True, False)]
    sizes = [side.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias(name)) for side, name in zip(sides, ("blocks", "askings"), strict=True)]
    both = sizes[0].join(sizes[1], "node")
    mine = lambda n: F.pmod(F.xxhash64("code"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = sides[0].join(both, "node").select("node", "code", "n", mine("blocks").alias("block"), each("askings").alias("asking"))
    asked = sides[1].join(both, "node").select("node", "code", "n", each("blocks").alias("block"), mine("askings").alias("asking"))
    key = ["node", "block", "asking"]
    met = home.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search, "code binary, n_near long, best_n long, best binary")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return met.groupBy("code").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("code", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, divisor: int | None = None, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, words_a_node: int = WORDS, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of docs; see words().

    A word's form is its near word of largest n (ties: the least), if that n is ``ratio`` times its own; root follows
    forms to the last, and is the word itself where it has none. ratio is at least 2, so that forms can't go round.
    Rows and doc_ids that repeat count as often as they are there; other columns are left aside; no words give no rows.
    Words are no longer than a task can hold. The result reads from tables in the shared folder.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    with common.scratch(docs.sparkSession) as scratch:
        found = scratch.table(words(docs, divisor, length, least), "words")
        best = near(found, depth_for(found.count(), words_a_node), block)
        rows = found.join(best, "code", "left")
        has = F.col("best_n") >= ratio * F.col("n")
        rows = scratch.table(rows.select("code", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
        links = rows.filter("form is not null").select("code", F.col("form").alias("to"))
        while True:
            ahead = links.select(F.col("code").alias("to"), F.col("to").alias("further"))
            longer = scratch.table(links.join(ahead, "to", "left").select("code", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "links")
            moved = not longer.filter("moved").isEmpty()
            links = longer.select("code", "to")
            if not moved:
                break
        scratch.keep(rows)
        scratch.keep(longer)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return rows.join(links, "code", "left").select(text(F.col("code")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("to", "code")).alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of documents, of which some lose a code point; see variants()."""
    return variants(common.load(spark, sf_dir, "documents"), divisor=DIVISOR)


#: Words replaced in one place are equal without it; a word with one inserted is the other without that.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')) AS w FROM documents),
l AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM r GROUP BY ALL HAVING length(w) >= {LENGTH}),
h AS (SELECT w, k, {checksums_sql.crc32("doc_id || ':' || w")} AS h FROM l),
d AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM h),
words AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM d GROUP BY w HAVING length(w) >= {LENGTH} AND sum(k) >= {LEAST}),
dels AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS x FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
pairs AS (SELECT a.w, b.w AS o FROM dels a JOIN dels b ON a.x = b.x AND a.i = b.i AND a.w <> b.w UNION SELECT w, x FROM dels WHERE x IN (SELECT w FROM words) UNION SELECT x, w FROM dels WHERE x IN (SELECT w FROM words)),
best AS (SELECT p.w, count(*) AS n_near, min((-o.n, o.w)) AS b FROM pairs p JOIN words o ON o.w = p.o GROUP BY p.w),
forms AS (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= {RATIO} * n THEN b[2] END AS form, CASE WHEN -b[1] >= {RATIO} * n THEN -b[1] END AS form_n FROM words LEFT JOIN best ON best.w = words.w),
path(w, stop) AS (SELECT w, w FROM forms UNION ALL SELECT path.w, form FROM path JOIN forms ON forms.w = path.stop WHERE form IS NOT NULL)
SELECT forms.w AS word, forms.form, stop AS root, forms.n, forms.n_near, forms.form_n FROM forms JOIN path ON path.w = forms.w JOIN forms last ON last.w = path.stop WHERE last.form IS NULL
"""
