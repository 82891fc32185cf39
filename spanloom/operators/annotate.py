"""Annotated texts: markers, parsing, validation, malformed spans, values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C

MARKER = r"(?s)\[\[(.*?)\]\]"
_ITEM = "struct<start:bigint,end:bigint,category:string,label:string,value:string,note:string>"


def marked(label: Column, value: Column) -> Column:
    return F.concat(F.lit("[[REAL_PII:"), label, F.lit("|"), value, F.lit("]]"))


def _mark(m: Column) -> Column:
    """struct(root, sub, name, value, wrong) of what a marker holds; value is empty where it is wrong."""
    left = F.substring_index(m, "|", 1)
    value = F.substring(m, F.length(left) + 2, F.length(m))
    root = F.upper(C.strip(F.substring_index(left, ":", 1)))
    sub = C.strip(F.substring(left, F.length(F.substring_index(left, ":", 1)) + 2, F.length(left)))
    wrong = (
        F.when(~m.contains("|") | ~left.contains(":"), "marker without root, label and value")
        .when(value == "", "empty value")
        .when(~root.isin("REAL_PII", "PII_LOOKALIKE", "NON_PII"), "unknown root")
        .when((root != "NON_PII") & ~F.upper(sub).isin(vocab.LABELS), "unknown label")
    )
    return F.struct(root.alias("root"), sub.alias("sub"), F.upper(sub).alias("name"), F.when(wrong.isNull(), value).otherwise("").alias("value"), wrong.alias("wrong"))


def parsed(annotated: Column) -> Column:
    """struct(text, items, error) of a text with markers [[ROOT:SUB|value]]: the plain text and the values' places in it.

    error names the first marker that is wrong: no "|" or ":" before it, an empty value, an unknown root or label. The
    text is put together once, from its pieces, and where a value stands follows from the lengths of those before it.
    """
    marks = F.transform(F.regexp_extract_all(annotated, F.lit(MARKER), F.lit(1)), _mark)
    plain = F.split(annotated, r"(?s)\[\[.*?\]\]", -1)

    def whole(both: Column) -> Column:
        marks, plain = both["marks"], both["plain"]
        sizes = F.transform(marks, lambda m, k: (F.length(F.get(plain, k)) + F.length(m["value"])).cast("bigint"))
        placed = F.zip_with(F.zip_with(marks, C.cumulated(sizes), lambda m, at: F.struct(m.alias("m"), at.alias("at"))), F.slice(plain, 1, F.size(marks)), lambda x, p: x.withField("at", (x["at"] + F.length(p)).cast("bigint")))

        def item(x: Column) -> Column:
            m = x["m"]
            note = F.when(m["root"] == "PII_LOOKALIKE", "public-context lookalike").when(m["root"] == "NON_PII", F.when(m["sub"] == "", "annotated").otherwise(m["sub"]))
            return F.struct(x["at"].alias("start"), (x["at"] + F.length(m["value"])).alias("end"), m["root"].alias("category"), F.when(m["root"] != "NON_PII", m["name"]).alias("label"), m["value"].alias("value"), note.alias("note")).cast(_ITEM)

        text = F.concat(F.array_join(F.zip_with(F.slice(plain, 1, F.size(marks)), marks, lambda p, m: F.concat(p, m["value"])), ""), F.get(plain, F.size(marks)))
        error = F.get(F.transform(F.filter(marks, lambda m: m["wrong"].isNotNull()), lambda m: m["wrong"]), F.lit(0))
        open_ = F.when(F.get(plain, F.size(plain) - 1).contains("[["), "unterminated marker")
        items = F.transform(F.filter(placed, lambda x: x["m"]["wrong"].isNull()), item)
        return F.struct(text.alias("text"), F.coalesce(items, F.array().cast(f"array<{_ITEM}>")).alias("items"), F.coalesce(error, open_).alias("error"))

    return F.transform(F.array(F.struct(marks.alias("marks"), plain.alias("plain"))), whole)[0]


def _item_fault(i: Column, text: Column, labels: list[str]) -> Column:
    """The first thing wrong with an item on its own."""
    category, label = F.when(i["category"].isin(labels), "REAL_PII").otherwise(i["category"]), F.when(i["category"].isin(labels), F.coalesce(i["label"], i["category"])).otherwise(i["label"])
    return (
        F.when(i["start"].isNull() | i["end"].isNull(), "start/end must be int")
        .when((i["start"] < 0) | (i["end"] <= i["start"]), "invalid bounds")
        .when(i["end"] > F.length(text), "out of range")
        .when(C.strip(C.slice_text(text, i["start"], i["end"])) == "", "only whitespace")
        .when(category.isNull() | ~category.isin("NON_PII", "PII_LOOKALIKE", "REAL_PII"), "invalid category")
        .when((category == "REAL_PII") & (label.isNull() | ~label.isin(labels)), "REAL_PII requires valid label")
        .when((category == "PII_LOOKALIKE") & (label.isNull() | ~F.upper(label).isin(labels)), "PII_LOOKALIKE requires valid label")
    )


def validated(docs: DataFrame, key: str) -> DataFrame:
    """key, status (OK, FAIL, RETRY) and reason of examples (key, text, items): the first failure in the fixed order.

    An item's own faults come before a later item's; of equal spans, one that a real label before it contradicts fails at its own place.
    """
    n = F.coalesce(F.size("items"), F.lit(0))
    rows = docs.select(key, "text", F.posexplode("items").alias("idx", "i"))
    labels = vocab.LABELS
    i = F.col("i")
    category = F.when(i["category"].isin(labels), "REAL_PII").otherwise(i["category"])
    label = F.when(i["category"].isin(labels), F.coalesce(i["label"], i["category"])).otherwise(i["label"])
    rows = rows.select(key, "idx", category.alias("category"), F.when(category == "REAL_PII", label).alias("real"), i["start"].alias("start"), i["end"].alias("end"), _item_fault(i, F.col("text"), labels).alias("fault"))
    same = Window.partitionBy(key, "start", "end").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("real").isin(labels), F.col("real")), ignorenulls=True).over(same)
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(F.col("real").isNotNull() & (before != F.col("real")), "conflicting REAL_PII labels")))
    per = rows.groupBy(key).agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("idx"))).alias("fault"), *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in vocab.LEAST))
    out = docs.select(key, "text", n.alias("n")).join(per, key, "left")
    retry = F.lit(None).cast("string")
    for c in ("NON_PII", "PII_LOOKALIKE", "REAL_PII"):
        retry = F.coalesce(retry, F.when(F.col(f"n_{c}") < vocab.LEAST[c], f"too few {c}"))
    for c in ("NON_PII", "PII_LOOKALIKE", "REAL_PII"):
        low, high = vocab.RATIOS[c]
        ratio = F.col(f"n_{c}") / F.col("n")
        retry = F.coalesce(retry, F.when((ratio < low) | (ratio > high), f"{c} ratio"))
    fail = F.when(F.col("text").isNull() | (C.strip(F.col("text")) == ""), "missing/empty text").when(F.col("n") == 0, "missing/empty items")
    count = F.when((F.col("n") < vocab.ITEMS[0]) | (F.col("n") > vocab.ITEMS[1]), "items count")
    status = F.when(fail.isNotNull(), "FAIL").when(count.isNotNull(), "RETRY").when(F.col("fault").isNotNull(), "FAIL").when(retry.isNotNull(), "RETRY").otherwise("OK")
    return out.select(key, status.alias("status"), F.coalesce(fail, count, F.col("fault"), retry).alias("reason"))


def malformed(text: Column, start: Column, end: Column, label: Column) -> Column:
    """Why a span can't be used; null: it can."""
    return (
        F.when(text.isNull(), "row text is not a string")
        .when(start.isNull() | end.isNull(), "start/end are not ints")
        .when((start < 0) | (end <= start) | (end > F.length(text)), "invalid bounds")
        .when(label.isNull(), "label is not a string")
        .when(C.strip(label) == "", "label is empty")
    )


def normalised(span: Column, text: Column) -> Column:
    """A span struct of any naming (start, end, start_position, end_position, label, entity_type, value, entity_value, category, sensitivity) in the one form; null without offsets."""
    pair = span["start"].isNull() | span["end"].isNull()
    start, end = F.when(pair, span["start_position"]).otherwise(span["start"]), F.when(pair, span["end_position"]).otherwise(span["end"])
    sens = F.upper(C.strip(span["sensitivity"]))
    form = F.struct(
        start.alias("start"),
        end.alias("end"),
        C.label(F.coalesce(span["label"], span["entity_type"])).alias("label"),
        F.coalesce(span["value"], span["entity_value"], C.slice_text(text, start, end)).alias("value"),
        span["category"].alias("category"),
        F.when(sens.isin("REDACT", "KEEP"), sens).alias("sensitivity"),
    )
    return F.when(start.isNotNull() & end.isNotNull(), form)


def spans_of(spans: Column, items: Column) -> Column:
    """A row's spans if it has any list of them, else those of its REAL_PII items that have offsets and a label."""
    real = F.filter(items, lambda i: (i["category"] == "REAL_PII") & i["start"].isNotNull() & i["end"].isNotNull() & i["label"].isNotNull())
    made = F.transform(real, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["label"].alias("label")))
    return F.coalesce(spans, made, F.array().cast("array<struct<start:bigint,end:bigint,label:string>>"))


def gold_rows(spans: Column, items: Column) -> Column:
    """All that a row's spans and its items say is gold, one after the other, both of them: struct(start, end, label), aliases of names and labels resolved, unknown labels kept. What has no offsets or no label, or NONE, is left out; a missing list is an empty one."""

    def form(s: Column) -> Column:
        pair = s["start"].isNull() | s["end"].isNull()
        label = C.label_kept(F.coalesce(s["label"], s["entity_type"]))
        return F.struct(F.when(pair, s["start_position"]).otherwise(s["start"]).alias("start"), F.when(pair, s["end_position"]).otherwise(s["end"]).alias("end"), label.alias("label"))

    some = [F.coalesce(F.transform(c, form), F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")) for c in (spans, items)]
    return F.filter(F.concat(*some), lambda s: s["start"].isNotNull() & s["end"].isNotNull() & F.coalesce((s["label"] != "NONE") & (s["label"] != ""), F.lit(False)))


def value_rows(text: Column, spans: Column, items: Column) -> Column:
    """The labelled values of a row's spans and then of its items: struct(label, value), values stripped. Labels as in gold_rows(); a value is value, else entity_value, else what the offsets have of the text, whatever their bounds; without any the span is left out."""

    def form(s: Column) -> Column:
        pair = s["start"].isNull() | s["end"].isNull()
        start, end = F.when(pair, s["start_position"]).otherwise(s["start"]), F.when(pair, s["end_position"]).otherwise(s["end"])
        value = F.coalesce(s["value"], s["entity_value"], F.when(start.isNotNull() & end.isNotNull(), C.slice_text(F.coalesce(text, F.lit("")), start, end)))
        return F.struct(C.label_kept(F.coalesce(s["label"], s["entity_type"])).alias("label"), C.strip(value).alias("value"))

    some = [F.coalesce(F.transform(c, form), F.array().cast("array<struct<label:string,value:string>>")) for c in (spans, items)]
    return F.filter(F.concat(*some), lambda s: F.coalesce(s["label"] != "NONE", F.lit(False)) & s["value"].isNotNull())


def spans_of_category(text: Column, items: Column, category: str) -> Column:
    """Items of the very category as spans (start, end, label, value) in order; a value that is missing is taken from the text."""
    some = F.filter(items, lambda i: i["category"] == category)
    return F.array_sort(F.transform(some, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["label"].alias("label"), F.coalesce(i["value"], C.slice_text(text, i["start"], i["end"])).alias("value"))))


def enriched(text: Column, spans: Column) -> Column:
    """struct(spans with values anew from their offsets, updated, mismatched): a span without offsets stays as it is; mismatched counts other values that were there before."""
    has = lambda s: s["start"].isNotNull() & s["end"].isNotNull()
    value = lambda s: C.slice_text(text, s["start"], s["end"])
    new = F.transform(spans, lambda s: F.when(has(s), s.withField("value", value(s))).otherwise(s))
    updated = F.size(F.filter(spans, has))
    mismatched = F.size(F.filter(spans, lambda s: has(s) & s["value"].isNotNull() & (s["value"] != value(s))))
    return F.struct(new.alias("spans"), F.coalesce(updated, F.lit(0)).cast("bigint").alias("updated"), F.coalesce(mismatched, F.lit(0)).cast("bigint").alias("mismatched"))


def retry_advice(reasons: DataFrame, most: int = 3) -> DataFrame:
    """One row, advice: the commonest reasons (reason, n, seen: where each was first seen) with their counts, earlier ones first among equals; null without any."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "seen", "reason", "n"))), 1, most)
    listed = F.array_join(F.transform(ranked, lambda x: F.concat(x["reason"], F.lit(" (x"), x["n"].cast("string"), F.lit(")"))), "; ")
    return reasons.agg(F.when(F.count(F.lit(1)) > 0, listed).alias("advice"))
