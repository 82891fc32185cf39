"""12 against a search over all edits of small conversations, and a plain dynamic program over audits."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest

from spanloom.llm import conversation_repair as repair

from .. import compare

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    """For each row: 0, 1 truncated, 2 blank, 3 duplicate."""
    seen, found = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)
        found.append(2 if not end else 3 if (role, text) in seen else 1 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    return found


def plain(rows):
    """cost, audit and repaired rows of (role, text) rows, by recursion over (row, last initial): the least (cost, audit)."""
    bad = faults(rows)

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        options = NEXT[last]
        if inserted < 4:
            for r in options.replace("s", ""):
                c, a, out = best(i, r, inserted + 1)
                found.append((c + 2, "I" + a, (({"u": "user", "a": "assistant"}[r], ""), *out)))
        if i < len(rows):
            role, text = rows[i]
            c, a, out = best(i + 1, last, 0)
            found.append((c + 3, "D" + a, out))
            if bad[i] < 2:
                if role[:1] and role[:1] in options:
                    c, a, out = best(i + 1, role[0], 0)
                    found.append((c + bad[i], "K" + a, ((role, text), *out)))
                for r in options.replace("s", ""):
                    c, a, out = best(i + 1, r, 0)
                    found.append((c + 2 + bad[i], "R" + a, (({"u": "user", "a": "assistant"}[r], text), *out)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    return best(0, "", 0)


def codes_of(rows):
    return [("sua".find(r[0]) if r[:1] and r[0] in "sua" else 3) + 4 * min(f, 2) for (r, _), f in zip(rows, faults(rows), strict=True)]


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "u", "sup"]
    weights = [6, 6, 2, 1, 1, 1, 1]
    return [(r, rng.choice(["Hello.", "Yes!", "cut off", "", " \n", "same?", f"t{rng.randrange(99)}."])) for r in rng.choices(roles, weights, k=n)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_solved(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    convs = [random_rows(rng, rng.randrange(1, 12)) for _ in range(400)]
    codes = np.array([c for rows in convs for c in codes_of(rows)], np.uint8)
    costs, audits = repair.solved(codes, np.array([len(rows) for rows in convs]))
    for rows, cost, (audit, _) in zip(convs, costs, audits, strict=True):
        assert (cost, audit.decode()) == plain(tuple(rows))[:2], rows


def test_one_long_conversation_in_blocks(monkeypatch):
    rng = random.Random(5)
    codes = np.array(codes_of(random_rows(rng, 5000)), np.uint8)
    whole = repair.solved(codes, np.array([5000]))
    monkeypatch.setattr(repair, "BLOCK", 64)
    assert repair.solved(codes, np.array([5000])) == whole


def test_ranks_choose_among_ends_of_equal_letters():
    """Of two arcs with one letter, that whose continuation is least; letters: 0 to 3."""
    u, v, letter = (np.array(x) for x in zip(*[(0, 1, 1), (0, 2, 1), (1, 3, 2), (2, 4, 2), (3, 5, 3), (4, 5, 0)], strict=True))
    rank = repair._ranks(6, u, v, letter, np.zeros(6, np.int64))
    assert rank[2] < rank[1] and rank[4] < rank[3] and rank[5] == 0
    letters, _, of, ends = repair._paths(6, (u, v, letter, letter), rank, np.array([0]))
    assert letters.tolist() == [1, 2, 0] and of.tolist() == [0, 0, 0] and ends.tolist() == [5]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        said = tuple((r[2], r[3]) for r in mine)
        bad, turns = faults(said), [r[1] for r in mine if r[1] is not None]
        cost, audit, out = plain(said)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in out)
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count(2), bad.count(3), bad.count(1), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def of_query(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of_query(repair.op12_conversation_repair(spark, sf)) == expected(rows)


def test_sql(spark, sf):
    compare.same(repair.op12_conversation_repair(spark, sf), compare.views(sf), repair.ORACLE)


def edge_rows():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["Hi.", "so", None, "", "é\U0001f600!", "line\n"])) for c in [*range(60), None] for t in rng.choices([0, 1, 2, 3, 5, 9, None, -4], k=rng.randrange(1, 9))]
    return rows + [(70, None, "user", "x. " * 50_000), (70, None, None, None), (71, 0, "user", "same."), (71, 0, "user", "same."), (71, 7, "user", "same.")]


def test_edges(spark, tmp_path):
    """Nulls everywhere, repeated rows and turns, long texts, clashing names; and no rows."""
    rows = edge_rows()
    schema = "conv_id long, turn long, role string, text string, audit string, _conv_id string, h1 string, c string, later string"
    spark.createDataFrame([(*r, "x", "y", "z", "c", "l") for r in rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    assert of_query(repair.op12_conversation_repair(spark, str(tmp_path))) == expected(rows)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert of_query(repair.op12_conversation_repair(spark, str(tmp_path / "none"))) == {}


def test_repaired_rows(spark):
    rows = edge_rows()
    found = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in {r[0] for r in rows}:
        sound = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        want = plain(tuple(r[1:] for r in sorted(sound, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))))
        got = sorted((r.at, r.role, r.text, r.edit) for r in found if r.conv_id == conv)
        assert [(r, t) for _, r, t, _ in got] == list(want[2])
        assert [e for *_, e in got] == [c for c in want[1] if c != "D"]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_batches(spark, batch):
    """A conversation over many batches of rows."""
    rng = random.Random(3)
    rows = [(c, t, r, x) for c, n in [(1, 300), (2, 1), (3, 40), (4, 2), (5, 800)] for t, (r, x) in enumerate(random_rows(rng, n))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {r.conv_id: r.audit for r in repair.plans(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {c: plain_long([(r[2], r[3]) for r in rows if r[0] == c]) for c in range(1, 6)}


def plain_long(rows):
    """The least audit, by a forward table of (cost, audit) for each last initial."""
    bad = faults(rows)
    table = {"": (0, "")}
    close = lambda t: [t.update({r: min(t.get(r, (10**9, "")), (c + 2, a + "I"))}) for _ in range(3) for q, (c, a) in list(t.items()) for r in NEXT[q].replace("s", "")]
    for (role, _), f in zip(rows, bad, strict=True):
        close(table)
        after = {}
        put = lambda q, c, a: after.update({q: min(after.get(q, (10**9, "")), (c, a))})
        for q, (c, a) in table.items():
            put(q, c + 3, a + "D")
            if f < 2:
                if role[:1] and role[0] in NEXT[q]:
                    put(role[0], c + f, a + "K")
                for r in NEXT[q].replace("s", ""):
                    put(r, c + 2 + f, a + "R")
        table = after
    close(table)
    return min(table[q] for q in ("", "a") if q in table)[1]
