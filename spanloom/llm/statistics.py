"""Statistics of texts as DataFrame expressions, for the quality rules and the quality classifier.

A word is a run of characters other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, INK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window whose repeats count.
WINDOW = 5
#: The statistics of add(), all long.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals", "n_distinct_words", "n_same_neighbours")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _from(array: Column, at: int) -> Column:
    """The array without its first ``at`` elements."""
    return F.slice(array, at + 1, F.greatest(F.size(array) - at, F.lit(0)))


def add(df: DataFrame, text: str, name: str, names: Iterable[str] = NAMES) -> DataFrame:
    """df with the struct column ``name`` of ``names``; a null text is an empty one. All of df's columns stay.

    Every text is worked on as a whole, however long; its arrays are as long as it has words.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    p = {k: fresh(df, f"{name}_{k}") for k in ("text", "words", "hashes", "windows", "repeating", "sorted", "places", "lines")}
    col = {k: F.col(v) for k, v in p.items()}
    out = df.select(*columns, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(p["text"]))
    out = out.select("*", F.filter(F.split(col["text"], BLANK), lambda w: w != "").alias(p["words"]), F.filter(F.split(col["text"], "\n"), lambda line: line.rlike(INK)).alias(p["lines"]))
    out = out.select("*", F.transform(col["words"], lambda w: F.xxhash64(w)).alias(p["hashes"]))
    n = F.size(col["words"])
    at = lambda a, i: F.get(col[a], i)
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    # hashes of two, of four and of five words in a row; those that reach past the end are cut off
    two = both(col["hashes"], _from(col["hashes"], 1))
    out = out.select("*", two.alias(p["windows"]))
    out = out.withColumn(p["windows"], both(col["windows"], _from(col["windows"], 2)))
    out = out.withColumn(p["windows"], F.slice(both(col["windows"], _from(col["hashes"], WINDOW - 1)), 1, F.greatest(n - WINDOW + 1, F.lit(0))))
    out = out.select("*", (F.size(F.array_distinct(col["windows"])) < F.size(col["windows"])).alias(p["repeating"]))
    ordered = F.sort_array(F.transform(col["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select("*", F.when(col["repeating"], ordered).alias(p["sorted"]))
    # where a window stands that stands elsewhere in the text too: next to an equal one in the sorted array
    twice = F.filter(col["sorted"], lambda x, j: (x["h"] == F.coalesce(at("sorted", j + 1)["h"], F.bitwise_not(x["h"]))) | ((j > 0) & (x["h"] == at("sorted", F.greatest(j - 1, F.lit(0)))["h"])))
    out = out.select("*", F.when(col["repeating"], F.sort_array(F.transform(twice, lambda x: x["i"]))).alias(p["places"]))
    gaps = F.zip_with(col["places"], _from(col["places"], 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    values = {
        "n_words": n,
        "word_chars": F.length(F.array_join(col["words"], "")),
        "n_symbols": F.regexp_count(col["text"], F.lit(SYMBOLS)),
        "n_dup_lines": F.size(col["lines"]) - F.size(F.array_distinct(col["lines"])),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda sum_, x: sum_ + x), F.lit(0)),
        "n_lines": F.size(col["lines"]),
        "n_bangs": F.length(col["text"]) - F.length(F.replace(col["text"], F.lit("!"), F.lit(""))),
        "n_capitals": F.regexp_count(col["text"], F.lit("[A-Z]")),
        "n_distinct_words": F.size(F.array_distinct(col["hashes"])),
        "n_same_neighbours": F.size(F.filter(F.zip_with(col["hashes"], _from(col["hashes"], 1), lambda a, b: a == b), lambda same: same)),
    }
    return out.select(*columns, F.struct(*(values[k].cast("long").alias(k) for k in names)).alias(name))
