"""12. Conversation structure repair: the cheapest edits that give a conversation alternating turns, and of these the least audit.

1. Faults. A row is blank, a duplicate (role and text were there before) or truncated; the least turn of each role and
   text, kept only where they repeat, tells duplicates without holding a conversation.
2. Costs. A row is a (min, +) matrix over the states of the grammar, insertions before it included. Products of the
   rows from each to the conversation's end come from doubled steps, all conversations of a block together, and give
   the least cost from every state before every row.
3. Audits. Arcs on which the least costs agree form an acyclic graph. Its nodes are ranked by the least audit's first
   letter, then by the first two, four, eight and so on, from the ranks of the nodes that these letters lead to. The
   arc of least letter and rank is each node's next one, and pointers of doubled length mark the least path.
4. Texts pass once, sorted by conversation, beside the audit that says what becomes of each.

A conversation's audit is one value and so is the hash of what is left of it, so its rows pass through one task in
Spark's order, whatever their number: of a row a byte is held there and the audit's letters, texts go by as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checksums_sql, common

#: What takes away a row's or text's end, in ASCII.
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = (".", "!", "?")

#: Role initials, and the state that each leads to: start, after s, after u, after a; -1: it isn't allowed there.
_INITIALS = "sua"
_STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_ENDING = np.array([True, False, False, True])
#: Roles that may be set and inserted, by initial.
_ROLES = {"u": "user", "a": "assistant"}
#: Audit letters in their ASCII order, and costs.
DELETE, INSERT, KEEP, REROLE = range(4)
_LETTERS = np.frombuffer(b"DIKR", np.uint8)
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1
#: Rows that are solved together.
BLOCK = 1 << 15

_FAR = 1 << 28


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of stacks of matrices."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for m in range(1, 4):
        np.minimum(out, a[:, :, m, None] + b[:, None, m, :], out=out)
    return out


def _arcs_of(code: int) -> list[tuple[int, int, int, int, int]]:
    """(state, state after, letter, initial set or 3, cost) of what may be done to a row; code: initial (3: another) + 4 * fault (1: truncated, 2: to be deleted)."""
    initial, fault = code % 4, code // 4
    arcs = [(q, q, DELETE, 3, COST[DELETE]) for q in range(4)]
    if fault < 2:
        more = TRUNCATED_COST * fault
        for q in range(4):
            if _STEP[q, initial] >= 0:
                arcs.append((q, _STEP[q, initial], KEEP, 3, COST[KEEP] + more))
            arcs += [(q, _STEP[q, r], REROLE, r, COST[REROLE] + more) for r in (1, 2) if r != initial and _STEP[q, r] >= 0]
    return arcs


_INSERTS = [(q, int(_STEP[q, r]), INSERT, r, COST[INSERT]) for q in range(4) for r in (1, 2) if _STEP[q, r] >= 0]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A matrix for each code, with insertions before the row, and the least costs after the last row."""
    insert = np.full((1, 4, 4), _FAR)
    insert[0, range(4), range(4)] = 0
    for q, to, _, _, cost in _INSERTS:
        insert[0, q, to] = min(insert[0, q, to], cost)
    for _ in range(3):
        insert = _product(insert, insert)
    rows = np.full((12, 4, 4), _FAR)
    for code in range(12):
        for q, to, _, _, cost in _arcs_of(code):
            rows[code, q, to] = min(rows[code, q, to], cost)
    end = (insert[0] + np.where(_ENDING, 0, _FAR)).min(axis=1)
    return np.minimum(_product(np.repeat(insert, 12, axis=0), rows), _FAR), end


_MATRICES, _END = _tables()
#: State, state after, letter, initial and cost of a code's arcs, and of insertions.
_ARCS = [np.array(_arcs_of(code)).T for code in range(12)]
_INSERT_ARCS = np.array(_INSERTS).T


def _costs(codes: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(layers, 4): the least cost from each state before each row and after the last of each conversation."""
    last = np.repeat(np.cumsum(lengths), lengths)
    suffix, step, at = _MATRICES[codes], 1, np.arange(len(codes))
    while step < (lengths.max() if len(lengths) else 0):
        more = at[at + step < last]
        suffix[more] = np.minimum(_product(suffix[more], suffix[more + step]), _FAR)
        step *= 2
    costs = np.tile(end, (len(codes) + len(lengths), 1))
    costs[at + np.repeat(np.arange(len(lengths)), lengths)] = (suffix + end).min(axis=2)
    return costs


def _optimal(codes: np.ndarray, lengths: np.ndarray, costs: np.ndarray, inner: bool) -> tuple[np.ndarray, ...]:
    """from, to, letter, initial of the arcs on which the least costs agree, in the order of from and letter; a node is 4 * layer + state. inner: nothing is inserted after the last row."""
    flat = costs.ravel()
    row_layer = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    inserting = row_layer if inner else np.arange(len(costs))
    found = []
    for layers, arcs, forward in [(inserting, _INSERT_ARCS, 0), *((row_layer[codes == c], _ARCS[c], 1) for c in np.unique(codes))]:
        q, to, letter, initial, cost = (x[None, :] for x in arcs)
        u, v = 4 * layers[:, None] + q, 4 * (layers[:, None] + forward) + to
        good = flat[u] == flat[v] + cost
        found.append([np.broadcast_to(x, good.shape)[good] for x in (u, v, letter, initial)])
    u, v, letter, initial = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((v, letter, u))
    return u[order], v[order], letter[order], initial[order]


def _ranks(n: int, u: np.ndarray, v: np.ndarray, letter: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """The order of the n nodes by their least audits. Audits end at nodes without arcs, whose order is ``ending``."""
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != u[:-1]
    least = np.zeros(n, np.int64)
    least[u[first]] = letter[first]
    rank = ending.astype(np.int64)
    rank[u[first]] = least[u[first]] + 1 + (ending.max() if n else 0)
    done = np.ones(n, bool)
    done[u] = False
    take = letter == least[u]
    a, b = np.concatenate([u[take], np.flatnonzero(done)]), np.concatenate([v[take], np.flatnonzero(done)])
    kinds = 0
    while True:
        # a, b: where the least audits of so many letters lead, all ends of them
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.searchsorted(a, np.arange(n))
        ahead = np.minimum.reduceat(rank[b], start) if n else rank
        values, ranked = np.unique(rank * (rank.max() + 1 if n else 1) + ahead, return_inverse=True)
        if len(values) == kinds:
            return ranked
        kinds = len(values)
        best = rank[b] == ahead[a]
        rank = ranked
        # each pair goes on with all pairs of its end
        x, y = a[best], b[best]
        stop = np.append(start[1:], len(a))
        good = np.cumsum(np.concatenate([[0], best]))
        lo, hi = good[start[y]], good[stop[y]]
        many = hi - lo
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.stack([np.repeat(x, many), b[best][np.repeat(lo, many) + within]]), axis=1) if (many > 1).any() else np.stack([x, b[best][lo]])
        a, b = pairs


def _paths(n: int, arcs: tuple[np.ndarray, ...], rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """letter, initial, number of the start and last node of the least paths from ``starts``, by pointers over 1, 2, 4 and more arcs."""
    u, v, letter, initial = arcs
    order = np.lexsort((v, rank[v], letter, u))
    u, v, letter, initial = u[order], v[order], letter[order], initial[order]
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != u[:-1]
    u, v, letter, initial = u[first], v[first], letter[first], initial[first]
    jump, left = np.arange(n), np.zeros(n, np.int64)
    jump[u], left[u] = v, 1
    of, on = np.full(n, -1), starts
    of[starts] = np.arange(len(starts))
    ends = starts
    while True:
        to = jump[on]
        fresh = of[to] < 0
        of[to] = of[on]
        on = np.concatenate([on, to[fresh]])
        ends = jump[ends]
        further = jump[jump]
        left = left + left[jump]
        if (further == jump).all():
            break
        jump = further
    path = u[of[u] >= 0]
    pick = np.searchsorted(u, path)
    order = np.lexsort((-left[path], of[path]))
    return letter[pick][order], initial[pick][order], of[path][order], ends


def _text(letters: np.ndarray, initials: np.ndarray) -> tuple[bytes, bytes]:
    return _LETTERS[letters].tobytes(), np.frombuffer(b"sua-", np.uint8)[initials].tobytes()


def _together(codes: np.ndarray, lengths: np.ndarray) -> tuple[list[int], list[tuple[bytes, bytes]]]:
    """Cost, and audit and initials set, of whole conversations one after another."""
    costs = _costs(codes, lengths, _END)
    arcs = _optimal(codes, lengths, costs, False)
    n = costs.size
    rank = _ranks(n, *arcs[:3], np.zeros(n, np.int64))
    starts = 4 * (np.cumsum(lengths) - lengths + np.arange(len(lengths)))
    letter, initial, of, _ = _paths(n, arcs, rank, starts)
    bounds = np.searchsorted(of, np.arange(len(lengths) + 1))
    return costs.ravel()[starts].tolist(), [_text(letter[a:b], initial[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _long(codes: np.ndarray) -> tuple[int, tuple[bytes, bytes]]:
    """As _together(), of one conversation in blocks: costs and ranks pass from each block to the one before, states on to the next."""
    bounds = [*range(0, len(codes), BLOCK), len(codes)]
    blocks = list(zip(bounds[:-1], bounds[1:], strict=True))
    tail = np.zeros(0, np.uint8)
    costs = _costs(tail, np.array([0]), _END)
    arcs = _optimal(tail, np.array([0]), costs, False)
    ahead = [(costs[0], _ranks(4, *arcs[:3], np.zeros(4, np.int64)))]

    def solved(a: int, b: int, end: np.ndarray, order: np.ndarray) -> tuple:
        lengths = np.array([b - a])
        costs = _costs(codes[a:b], lengths, end)
        arcs = _optimal(codes[a:b], lengths, costs, True)
        ending = np.zeros(costs.size, np.int64)
        ending[-4:] = order
        return costs, arcs, _ranks(costs.size, *arcs[:3], ending)

    for a, b in reversed(blocks):
        costs, _, rank = solved(a, b, *ahead[-1])
        ahead.append((costs[0], np.unique(rank[:4], return_inverse=True)[1]))
    total, state, parts = int(ahead[-1][0][0]), 0, []
    for k, (a, b) in enumerate(blocks):
        costs, arcs, rank = solved(a, b, *ahead[len(blocks) - 1 - k])
        letter, initial, _, ends = _paths(costs.size, arcs, rank, np.array([state]))
        parts.append(_text(letter, initial))
        state = int(ends[0]) % 4
    costs = _costs(tail, np.array([0]), _END)
    arcs = _optimal(tail, np.array([0]), costs, False)
    letter, initial, _, _ = _paths(4, arcs, ahead[0][1], np.array([state]))
    parts.append(_text(letter, initial))
    return total, (b"".join(p[0] for p in parts), b"".join(p[1] for p in parts))


def solved(codes: np.ndarray, lengths: np.ndarray) -> tuple[list[int], list[tuple[bytes, bytes]]]:
    """Cost, and audit and initials set, of conversations one after another, each of one row at least."""
    costs, audits, c, a = [], [], 0, 0
    while c < len(lengths):
        if lengths[c] > BLOCK:
            found = _long(codes[a : a + lengths[c]])
            found, size, more = ([found[0]], [found[1]]), int(lengths[c]), 1
        else:
            more = max(1, int(np.searchsorted(np.cumsum(lengths[c:]), BLOCK, side="right")))
            size = int(lengths[c : c + more].sum())
            found = _together(codes[a : a + size], lengths[c : c + more])
        costs += found[0]
        audits += found[1]
        c, a = c + more, a + size
    return costs, audits


_PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, set string"
_ORDER = ["turn", "role", "begin", "h1", "h2"]


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for null, and where they are not null."""
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


#: Of a conversation so far: rows, least and most turn, different turns, blank, duplicate, truncated rows, illegal neighbours.
_COUNTS = 8


def _coded(rows: pa.Table, skip: int) -> tuple[list[int | None], np.ndarray, np.ndarray, bool]:
    """Of rows sorted by conv_id and _ORDER, the first ``skip`` of which (0 or 1) stand there for comparison only: conversations, their counts, a code for each row, and whether the first conversation is that of the skipped row."""
    conv, conv_set = _numbers(rows.column("conv_id"))
    turn, turn_set = _numbers(rows.column("turn"))
    h1, h2 = rows.column("h1").to_numpy(), rows.column("h2").to_numpy()
    initial, fault = rows.column("initial").to_numpy(), rows.column("fault").to_numpy()
    same = np.zeros(len(conv), bool)
    same[1:] = (conv[1:] == conv[:-1]) & (conv_set[1:] == conv_set[:-1])
    turned = same.copy()
    turned[1:] &= (turn[1:] == turn[:-1]) & (turn_set[1:] == turn_set[:-1])
    again = turned.copy()
    again[1:] &= (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    # faults: 0 none, 1 truncated, 2 blank, 3 duplicate; a blank row stays blank
    fault = np.where((fault < 2) & (again | rows.column("later").to_numpy(zero_copy_only=False)), 3, fault)
    illegal = same.copy()
    illegal[1:] &= ~(((initial[:-1] == 0) | (initial[:-1] == 2)) & (initial[1:] == 1) | (initial[:-1] == 1) & (initial[1:] == 2))
    starts = np.flatnonzero(~same[skip:] | (np.arange(len(conv) - skip) == 0))
    count = lambda hit: np.add.reduceat(hit[skip:].astype(np.int64), starts)
    top = np.iinfo(np.int64).max
    least, most = np.minimum.reduceat(np.where(turn_set, turn, top)[skip:], starts), np.maximum.reduceat(np.where(turn_set, turn, -top)[skip:], starts)
    counts = np.stack([np.diff(np.append(starts, len(conv) - skip)), least, most, count(turn_set & ~turned), count(fault == 2), count(fault == 3), count(fault == 1), count(illegal)], axis=1)
    return rows.column("conv_id").slice(skip).take(pa.array(starts)).to_pylist(), counts, (initial + 4 * np.minimum(fault, 2)).astype(np.uint8)[skip:], bool(skip and same[1])


def _planned(convs: list[int | None], counts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    rows, least, most, turns, blank, duplicate, truncated, illegal = counts.T
    gaps = np.where(turns > 0, np.where(turns > 0, most, 0) - np.where(turns > 0, least, 0) + 1 - turns, 0)
    costs, audits = solved(codes, rows)
    columns = [pa.array(convs, pa.int64()), *(pa.array(x) for x in (gaps, blank, duplicate, truncated, illegal, np.array(costs, np.int64))), pa.array([a.decode() for a, _ in audits]), pa.array([s.decode() for _, s in audits])]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "set"])


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of sorted rows, a byte of each of which is kept until its conversation and BLOCK rows are whole."""
    convs, counts, codes, last = [], np.zeros((0, _COUNTS), np.int64), [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if last is None else [last, batch])
        more, found, coded, goes_on = _coded(rows, 0 if last is None else 1)
        last = batch.slice(batch.num_rows - 1)
        if goes_on:
            mine = counts[-1]
            mine[1], mine[2] = min(mine[1], found[0, 1]), max(mine[2], found[0, 2])
            mine[[0, 3, 4, 5, 6, 7]] += found[0, [0, 3, 4, 5, 6, 7]]
            more, found = more[1:], found[1:]
        convs, counts, codes = convs + more, np.concatenate([counts, found]), [*codes, coded]
        whole = int(counts[:-1, 0].sum())
        if whole >= BLOCK:
            together = np.concatenate(codes)
            yield _planned(convs[:-1], counts[:-1], together[:whole])
            convs, counts, codes = convs[-1:], counts[-1:].copy(), [together[whole:]]
    if convs:
        yield _planned(convs, counts, np.concatenate(codes))


def _sound(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("begin"), *(F.xxhash64(F.lit(s), "role", "text").alias(f"h{s}") for s in (1, 2)), "text")


def plans(convs: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and set: a letter of the audit for each edit in order (Delete, Insert, Keep, Rerole), and in ``set`` the initial of the role that an insertion or a new role has, or a hyphen.

    convs: conv_id, turn, role, text, other columns are left aside. Rows are taken by turn, nulls first, then by role,
    the first 32 characters of their text and its hash; nulls in role or text are one space, a null conv_id is a
    conversation like others. No rows give no rows.
    """
    rows = _keyed(_sound(convs))
    end = F.rtrim("text", F.lit(_SPACE))
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, F.lit(k)) for k, c in enumerate(_INITIALS)), F.lit(3))
    fault = F.when(end == "", 2).when(F.substring(end, -1, 1).isin(*_ENDS), 0).otherwise(1)
    rows = rows.select("conv_id", *_ORDER, initial.alias("initial"), fault.alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeats = rows.groupBy(F.col("conv_id").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = rows.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    later = F.coalesce(place > F.col("first"), F.lit(False))
    slim = met.select("conv_id", *_ORDER, "initial", "fault", later.alias("later"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "turn", "h1", "h2", "initial", "fault", "later").mapInArrow(_plans, _PLAN)


class _Hashed:
    """Conversations' repaired rows as they come, as one digest each."""

    schema = "conv_id long, repaired_sha256 string"

    def __init__(self):
        self.found, self.hash, self.any = [], None, False

    def row(self, conv: int | None, role: str, text: str, edit: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode())

    def begin(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def end(self, conv: int | None) -> None:
        self.found.append((conv, self.hash.hexdigest()))

    def taken(self) -> pa.RecordBatch:
        found, self.found = self.found, []
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([h for _, h in found], pa.string())], names=["conv_id", "repaired_sha256"])


class _Rows:
    """The repaired rows themselves."""

    schema = "conv_id long, at long, role string, text string, edit string"

    def __init__(self):
        self.found, self.at = [], 0

    def row(self, conv: int | None, role: str, text: str, edit: str) -> None:
        self.found.append((conv, self.at, role, text, edit))
        self.at += 1

    def begin(self) -> None:
        self.at = 0

    def end(self, conv: int | None) -> None:
        pass

    def taken(self) -> pa.RecordBatch:
        found, self.found = self.found, []
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=["conv_id", "at", "role", "text", "edit"])


def _apply(kind: type, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conversations, each after the row with its audit, whose letters go with them."""
    out, conv, audit, goals, at = kind(), None, None, None, 0

    def inserted(at: int) -> int:
        while at < len(audit) and audit[at] == "I":
            out.row(conv, _ROLES[goals[at]], "", "I")
            at += 1
        return at

    for batch in batches:
        for c, is_text, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "is_text", "role", "text")), strict=True):
            if not is_text:
                if audit is not None:
                    inserted(at)
                    out.end(conv)
                conv, audit, goals, at = c, text, role, 0
                out.begin()
                continue
            at = inserted(at)
            letter = audit[at]
            if letter != "D":
                out.row(conv, _ROLES[goals[at]] if letter == "R" else role, text, letter)
            at += 1
        yield out.taken()
    if audit is not None:
        inserted(at)
        out.end(conv)
        yield out.taken()


def _applied(convs: DataFrame, planned: DataFrame, kind: type) -> DataFrame:
    texts = _keyed(_sound(convs)).select("conv_id", F.lit(True).alias("is_text"), *_ORDER, "text")
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in _ORDER[2:]]
    audits = planned.select("conv_id", F.lit(False).alias("is_text"), F.lit(None).cast("long").alias("turn"), F.col("set").alias("role"), *none, F.col("audit").alias("text"))
    both = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_text", *_ORDER)
    return both.select("conv_id", "is_text", "role", "text").mapInArrow(lambda batches: _apply(kind, batches), kind.schema)


def repaired(convs: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text and edit (I, K or R) of the rows that plans()' edits leave or insert; a conversation that loses all its rows has none."""
    return _applied(convs, plans(convs), _Rows)


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fault in a quarter of the rows, by the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls are one space there and in role and text."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = _sound(convs).withColumn("kind", F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conv_id of conversations with the faults of its damaged rows, the cheapest repair's cost and audit, and the digest of the repaired rows; see damaged(), plans() and repaired()."""
    convs = common.load(spark, sf_dir, "conversations")
    rows = damaged(convs)
    with common.scratch(spark) as scratch:
        planned = scratch.table(plans(rows), "plans")
        scratch.keep(planned)
    digests = _applied(rows, planned, _Hashed)
    ids = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return _digested(_left(_left(ids, planned), digests))


def _left(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the columns of more, whose conv_id is unique, by conv_id, null too."""
    return rows.join(more.withColumnRenamed("conv_id", "_conv_id"), F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")


def _digested(rows: DataFrame) -> DataFrame:
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A forward table of the least (cost, audit) for each state after each row; of equal costs a state's least audit so far stays the least, as an initial leads from a state to one state alone.
ORACLE = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {checksums_sql.crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, rtrim(text, {_WHITE}) AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 3 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault, left(role, 1) AS init, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (rn > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
ins(q, q1, a, added) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])),
arc(q1, q2, e, init, new) AS (VALUES (0, 0, 'D', NULL, NULL), (1, 1, 'D', NULL, NULL), (2, 2, 'D', NULL, NULL), (3, 3, 'D', NULL, NULL), (0, 1, 'K', 's', NULL), (0, 2, 'K', 'u', NULL), (1, 2, 'K', 'u', NULL), (2, 3, 'K', 'a', NULL), (3, 2, 'K', 'u', NULL), (0, 2, 'R', NULL, 'user'), (1, 2, 'R', NULL, 'user'), (2, 3, 'R', NULL, 'assistant'), (3, 2, 'R', NULL, 'user')),
t(conv_id, i, q, best) AS (SELECT conv_id, 0::BIGINT, 0, (0::BIGINT, '', []::VARCHAR[]) FROM s UNION ALL
  SELECT t.conv_id, t.i + 1, arc.q2, min((best[1] + 2 * length(ins.a) + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 1 THEN 1 ELSE 0 END, best[2] || ins.a || e, best[3] || ins.added || CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [arc.new || ':' || f.text] END))
  FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.rn = t.i + 1 JOIN ins ON ins.q = t.q JOIN arc ON arc.q1 = ins.q1 WHERE (e = 'D' OR fault < 2) AND (arc.init IS NULL OR arc.init = f.init) GROUP BY t.conv_id, t.i, arc.q2),
z AS (SELECT t.conv_id, min((best[1] + 2 * length(ins.a), best[2] || ins.a, best[3] || ins.added)) AS b FROM t JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = s.n JOIN ins ON ins.q = t.q WHERE ins.q1 IN (0, 3) GROUP BY t.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b[1], 0) AS cost, coalesce(b[2], '') AS audit, sha256(coalesce(array_to_string(b[3], chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
