"""How the values of predictions and gold stand to each other within a document, by an automaton over the values.

All values that lie in another are found in one pass over that other, so a document takes time by the length of its
values and the pairs there are, not by predictions times gold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Value = tuple[str | None, str | None]

#: Products of the sizes of both sides up to which values are compared one by one.
_FEW = 64
_STRUCT = pa.struct([(c, pa.string()) for c in ("kind", "pred_label", "pred_value", "gold_label", "gold_value")])
SCHEMA = "array<struct<kind:string,pred_label:string,pred_value:string,gold_label:string,gold_value:string>>"


def inside(values: set[str], texts: set[str]) -> dict[str, set[str]]:
    """For each text that holds any, the values that it holds; empty ones lie in none."""
    found: dict[str, set[str]] = {}
    values = {v for v in values if v}
    if len(values) * len(texts) <= _FEW:
        for text in texts:
            if held := {v for v in values if v in text}:
                found[text] = held
        return found
    machine = ahocorasick.Automaton()
    for value in values:
        machine.add_word(value, value)
    machine.make_automaton()
    for text in texts:
        if held := {v for _, v in machine.iter(text)}:
            found[text] = held
    return found


def related(pred: set[Value], gold: set[Value]) -> list[tuple]:
    """(kind, predicted label and value, gold label and value); see evaluate.relationships()."""
    both = pred & gold
    out = [("tp", *x, *x) for x in both]
    pool = gold - both
    rest = sorted(pred - both, key=lambda x: tuple((c is not None, c) for c in x))
    p_values, g_values = ({v for _, v in side if v is not None} for side in (rest, pool))
    # gold values inside of predicted ones, and gold values around them
    smaller, around = inside(g_values, p_values), defaultdict(list)
    for value, held in inside(p_values, g_values).items():
        for v in held:
            around[v].append(value)
    labels: dict[str, set] = defaultdict(set)
    for label, value in pool:
        labels[value].add(label)
    for label, value in rest:
        best = None
        if value is not None:
            other = lambda a: a is None or label is None or a != label  # noqa: B023, E731
            for kind, values in enumerate(([value], around.get(value, ()), smaller.get(value, ()))):
                for v in values:
                    if kind and v == value:
                        continue
                    for a in labels.get(v, ()):
                        if kind == 0 and (a is None or label is None or a == label):
                            continue
                        rank = kind, other(a), abs(len(value) - len(v)), (a is not None, a), v
                        if best is None or rank < best[0]:
                            best = rank, a, v
                if best is not None:
                    break
        if best is None:
            out.append(("fp", label, value, None, None))
            continue
        _, a, v = best
        labels[v].discard(a)
        pool.discard((a, v))
        out.append((("mismatch", "subset", "superset")[best[0][0]], label, value, a, v))
    return out + [("fn", None, None, *y) for y in pool]


def relationships(pred: Column, gold: Column) -> Column:
    """An array of what related() gives for two arrays of struct(label, value), which count as sets."""

    def batches(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in it:
            rows = []
            for p, g in zip(*(c.to_pylist() for c in columns), strict=True):
                sides = [{(x["label"], x["value"]) for x in side or ()} for side in (p, g)]
                rows.append([dict(zip(_STRUCT.names, r, strict=True)) for r in related(*sides)])
            yield pa.array(rows, pa.list_(_STRUCT))

    batches.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, SCHEMA)(pred, gold)


def merged(rows: list[dict]) -> list[str]:
    """The kinds of a document's relationships, each with p and g, its values' compared forms: supersets made of gold values become merged, and the missed values among these used; see evaluate.merged_supersets()."""
    kinds = [r["kind"] for r in rows]
    supers = [k for k, r in enumerate(rows) if r["kind"] == "superset" and r["pred_label"] is not None and r["pred_label"] == r["gold_label"] and r["p"] is not None and r["g"] is not None]
    by_form: dict[str, list[int]] = defaultdict(list)
    for k, r in enumerate(rows):
        if r["kind"] == "fn" and r["g"]:
            by_form[r["g"]].append(k)
    held = inside(set(by_form), {rows[k]["p"] for k in supers})
    for k in sorted(supers, key=lambda k: tuple(rows[k][c] for c in ("pred_label", "pred_value", "gold_value"))):
        row = rows[k]
        parts = [m for form in held.get(row["p"], ()) for m in by_form[form] if kinds[m] == "fn" and rows[m]["gold_label"] == row["pred_label"]]
        if len({row["g"], *(rows[m]["g"] for m in parts)}) >= 2 and row["g"] in row["p"]:
            kinds[k] = "merged"
            for m in parts:
                kinds[m] = "used"
    return kinds


def merged_kinds(rows: Column) -> Column:
    """An array of merged()'s kinds for an array of struct(kind, pred_label, pred_value, gold_label, gold_value, p, g)."""

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            yield pa.array([merged(r or []) for r in column.to_pylist()], pa.list_(pa.string()))

    batches.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<string>")(rows)
