"""Rows from texts: pattern matches, candidate spans, windows, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C

OPEN, CLOSE = "\x01", "\x02"


def parts(text: Column, pattern: str) -> Column:
    """The text cut at the pattern's matches: what stands before the first, then for each match its text, U+0002 and what follows. U+0001 and U+0002 in the text count as U+0003 there, which the patterns take for the same."""
    held = text.contains(OPEN) | text.contains(CLOSE)
    return F.split(F.regexp_replace(F.when(held, F.translate(text, OPEN + CLOSE, "\x03\x03")).otherwise(text), pattern, f"{OPEN}$0{CLOSE}"), OPEN)


def _folded(cut: Column) -> Column:
    """places(), by a fold: the quickest way for few matches."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    first = F.struct(F.length(F.get(cut, F.lit(0))).cast("bigint").alias("at"), empty.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        here = F.struct(acc["at"].alias("start"), (acc["at"] + F.locate(CLOSE, part) - 1).cast("bigint").alias("end"))
        return F.struct((acc["at"] + F.length(part) - 1).cast("bigint").alias("at"), F.array_append(acc["found"], here).alias("found"))

    return F.aggregate(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), first, step)["found"]


def places(cut: Column) -> Column:
    """array<struct<start, end>> of the matches, left to right, from a column of parts()."""
    # every part but the first begins with a match and holds U+0002
    sizes = F.transform(cut, lambda part, i: (F.length(part) - F.when(i > 0, 1).otherwise(0)).cast("bigint"))
    found = F.zip_with(cut, C.cumulated(sizes), lambda part, at: F.struct(at.alias("start"), (at + F.locate(CLOSE, part) - 1).cast("bigint").alias("end")))
    return F.when(F.size(cut) <= C.RUN, _folded(cut)).otherwise(F.slice(found, 2, F.greatest(F.size(cut) - 1, F.lit(0))))


def searched(text: Column, pattern: str, needed: str | None = None) -> Column:
    """parts(); null for a text that doesn't hold ``needed``, a pattern that every match holds."""
    return parts(text, pattern) if needed is None else F.when(text.rlike(needed), parts(text, pattern))


def matches(text: Column, pattern: str, needed: str | None = None) -> Column:
    """places() of a pattern as one expression, in which the matches are found once."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.coalesce(F.get(F.transform(F.array(searched(text, pattern, needed)), places), F.lit(0)), none)


def _hits(docs: DataFrame, keep: list[str], text: str, patterns: dict[str, str]) -> tuple[DataFrame, Column]:
    """keep and the parts of all patterns, and from these an array of struct(label, hits), hits being null without a match."""
    names = {name: f"_parts_{name}" for name in patterns}
    cut = docs.select(*keep, *(searched(F.col(text), p, vocab.NEEDED.get(name) if p == vocab.PATTERNS.get(name) else None).alias(names[name]) for name, p in patterns.items()))
    return cut, F.array(*(F.struct(F.lit(name).alias("label"), F.when(F.size(names[name]) > 1, places(F.col(names[name]))).alias("hits")) for name in patterns))


def found(docs: DataFrame, keep: list[str], text: str, patterns: dict[str, str] = vocab.PATTERNS) -> DataFrame:
    """keep, label, start, end of every match of every pattern: one pass over the texts, each pattern once, nothing shuffled."""
    cut, hits = _hits(docs, keep, text, patterns)
    rows = cut.select(*keep, F.explode(hits).alias("of")).filter("of.hits is not null")
    return rows.select(*keep, "of.label", F.explode("of.hits").alias("hit")).select(*keep, "label", F.col("hit.start").alias("start"), F.col("hit.end").alias("end"))


def listed(docs: DataFrame, keep: list[str], text: str, patterns: dict[str, str] = vocab.PATTERNS) -> DataFrame:
    """keep and spans, an array of struct(label, start, end): the matches of all patterns in their document's row."""
    cut, hits = _hits(docs, keep, text, patterns)
    rows = cut.select(*keep, hits.alias("of"))
    one = lambda of: F.transform(of["hits"], lambda h: F.struct(of["label"].alias("label"), h["start"].alias("start"), h["end"].alias("end")))
    return rows.select(*keep, F.flatten(F.transform(F.filter("of", lambda of: of["hits"].isNotNull()), one)).alias("spans"))


def pattern_spans(docs: DataFrame, key: str, text: str, patterns: dict[str, str] = vocab.PATTERNS, with_text: bool = False) -> DataFrame:
    """key, label, start, end, value of every match of every pattern, and the text if it is to stay."""
    rows = found(docs, [key, text], text, patterns)
    return rows.select(key, "label", "start", "end", C.slice_text(F.col(text), F.col("start"), F.col("end")).alias("value"), *([text] if with_text else []))


def candidate_count(n: Column, most: int) -> Column:
    """Token spans of at most ``most`` tokens among n tokens."""
    m = F.least(n, F.lit(most)).cast("bigint")
    return m * n - (m * (m - 1) / 2).cast("bigint")


def candidates(per_doc: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """key, ts, te of all token spans of at most ``most`` tokens."""
    starts = per_doc.filter(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias("ts"))
    return starts.select(key, "ts", F.explode(F.sequence(F.col("ts"), F.least(F.col("ts") + most - 1, F.col(n) - 1))).alias("te"))


def windows(per_doc: DataFrame, key: str, n: str, size: int, stride: int | None = None) -> DataFrame:
    """key, window, ts, te: overlapping runs of ``size`` tokens, ``stride`` of which two neighbours share."""
    step = max(1, size - (stride if stride is not None else max(1, size // 8)))
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(n) - size) / step))
    rows = per_doc.filter(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("window"))
    return rows.select(key, "window", (F.col("window") * step).alias("ts"), (F.least(F.col("window") * step + size, F.col(n)) - 1).alias("te"))


def sentence_chunks(text: Column, chunk: int) -> Column:
    """array<string>: sentences packed in order while a chunk stays under 4 * chunk characters."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) < 4 * chunk
        grown = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        closed = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        return F.when(fits, F.struct(grown.alias("now"), acc["done"].alias("done"))).otherwise(F.struct(s.alias("now"), closed.alias("done")))

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
