"""Small aggregated frames as Markdown and HTML: counts by label and kind, never rows of the corpus."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

#: Rows of a table in a report, as the largest counts.
ROWS = 25


def table(headers: list[str], rows: list[tuple]) -> str:
    """A Markdown table; a dash for none."""
    if not rows:
        return "-\n"
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(headers), "|" + "---|" * len(headers), *map(line, rows)]) + "\n"


def top(df: DataFrame, by: list[str], n: str = "n") -> list[tuple]:
    """The largest counts, by name among equal ones."""
    from pyspark.sql import functions as F

    return [tuple(r) for r in df.select(*by, n).orderBy(F.desc(n), *by).limit(ROWS).collect()]


def markdown(taxonomy: DataFrame, confusion: DataFrame) -> str:
    """From error_taxonomy (kind, label, n) and confusion_matrix (pred_label, gold_label, n)."""
    parts = ["# Errors\n"]
    for kind, title in (("tp", "Exact"), ("fp", "False positives"), ("fn", "False negatives"), ("subset", "Too short"), ("superset", "Too long"), ("merged", "Several in one")):
        parts.append(f"## {title}\n\n" + table(["label", "count"], top(taxonomy.filter(f"kind = '{kind}'"), ["label"])))
    parts.append("## Other label\n\n" + table(["predicted", "gold", "count"], top(confusion.filter("n > 0"), ["pred_label", "gold_label"])))
    return "\n".join(parts)


def summary(sides: DataFrame, totals: DataFrame, confusion: DataFrame) -> dict:
    """From by_side(), totals() and confusion(): counts by kind, side and label, totals, all labels, and mismatches with the most frequent first."""
    counts: dict[str, dict[str, int]] = {}
    for r in sides.orderBy("kind", "side", "label").collect():  # kinds and sides times labels
        counts.setdefault(f"{r['kind']}_by_{r['side']}", {})[r["label"]] = r["n"]
    row = totals.first().asDict()
    names = [x for x in row.pop("labels").split(",") if x]
    worst = [{"predicted": p, "gold": g, "count": n} for p, g, n in top(confusion.filter("n > 0"), ["pred_label", "gold_label"])]
    return {"totals": row, "labels": names, "counts": counts, "mismatches": worst}


def html(taxonomy: DataFrame, confusion: DataFrame) -> str:
    """Bars of the counts by kind and label, and the confusion as a shaded grid."""
    counts = top(taxonomy, ["kind", "label"])
    most = max([n for *_, n in counts], default=1)
    bars = "".join(f"<tr><td>{escape(str(k))} {escape(str(v))}</td><td><div style='width:{300 * n // most}px;background:#69c'>{n}</div></td></tr>" for k, v, n in counts)
    cells = {(r["pred_label"], r["gold_label"]): r["n"] for r in confusion.collect()}  # the taxonomy's labels squared
    names = sorted({k for pair in cells for k in pair})
    worst = max(cells.values(), default=0) or 1
    grid = "".join("<tr><th>" + escape(a) + "</th>" + "".join(f"<td style='background:rgba(200,60,60,{cells.get((a, b), 0) / worst:.2f})'>{cells.get((a, b), 0)}</td>" for b in names) + "</tr>" for a in names)
    head = "<tr><th></th>" + "".join(f"<th>{escape(b)}</th>" for b in names) + "</tr>"
    return f"<!doctype html><meta charset=utf-8><title>Errors</title><table>{bars}</table><table>{head}{grid}</table>"


def console(metrics: dict[str, float]) -> str:
    return "\n".join(f"{k:<24}{v:>12.4f}" if isinstance(v, float) else f"{k:<24}{v:>12}" for k, v in metrics.items())
