"""Expressions on single columns. Offsets are code points; ends are exclusive for characters, inclusive for tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def strip(c: Column) -> Column:
    """Without white space at both ends, as Python has it."""
    return F.regexp_replace(c, f"^{vocab.SPACE}+|{vocab.SPACE}+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both ends clamped to the text."""
    s = F.greatest(F.lit(0), F.least(start, F.length(text)))
    e = F.greatest(s, F.least(end, F.length(text)))
    return F.substring(text, (s + 1).cast("int"), (e - s).cast("int"))


def label(c: Column) -> Column:
    """Stripped, upper case, aliases resolved; unknown: OTHER; empty: null."""
    up = F.upper(strip(c))
    known = F.coalesce(F.try_element_at(literal_map(vocab.ALIASES), up), up)
    return F.when(up == "", None).when(known.isin(vocab.TRAINING_LABELS), known).otherwise(F.when(up.isNotNull(), "OTHER"))


def label_kept(c: Column) -> Column:
    """As label(), but an unknown one stays."""
    up = F.upper(strip(c))
    return F.coalesce(F.try_element_at(literal_map(vocab.ALIASES), up), up)


def safe_label(c: Column) -> Column:
    return F.when(c.isNull() | (strip(c) == ""), "UNKNOWN").otherwise(F.upper(strip(c)))


def safe_value(c: Column) -> Column:
    """A value, empty where there is none."""
    return F.coalesce(c, F.lit(""))


def sensitivity(category: Column) -> Column:
    return F.try_element_at(literal_map(vocab.SENSITIVITY), F.upper(category))


def compact(c: Column, most: int = 220) -> Column:
    one = collapse(c)
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("..."))).otherwise(one)


def slug(c: Column) -> Column:
    parts = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9._-]+", "-"), "-+", "-")
    trimmed = F.regexp_replace(parts, "^-+|-+$", "")
    return F.when(trimmed == "", "model").otherwise(trimmed)


def uniform(key: Column) -> Column:
    """A number in [0, 1) that the key's digest fixes."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return p, r, safe_div(2 * p * r, p + r)


def chars_overlap(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    return F.greatest(s0, s1) < F.least(e0, e1)


def char_iou(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    common = F.greatest(F.lit(0), F.least(e0, e1) - F.greatest(s0, s1))
    union = (e0 - s0) + (e1 - s1) - common
    return F.when((common <= 0) | (union <= 0), F.lit(0.0)).otherwise(common / F.when(union != 0, union))


def overlap_credit(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """Of token spans with inclusive ends: 1 if equal, else 2^-(tokens outside the intersection), 0 if disjoint."""
    m, n = F.greatest(F.lit(0), e0 - s0 + 1), F.greatest(F.lit(0), e1 - s1 + 1)
    k = F.greatest(F.lit(0), F.least(e0, e1) - F.greatest(s0, s1) + 1)
    return F.when((s0 == s1) & (e0 == e1), F.lit(1.0)).when((m <= 0) | (n <= 0) | (k <= 0), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -(m + n - k).cast("double")))


def overlap_ratio(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """Of token spans with inclusive ends: the intersection over the shorter."""
    k = F.greatest(F.lit(0), F.least(e0, e1) - F.greatest(s0, s1) + 1)
    return F.when(k <= 0, F.lit(0.0)).otherwise(k / F.least(e0 - s0 + 1, e1 - s1 + 1))


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without white space at both ends; null if nothing is left."""
    s = F.greatest(F.lit(0), F.least(start, F.length(text))).cast("bigint")
    value = slice_text(text, start, end)
    lead = F.length(value) - F.length(F.regexp_replace(value, f"^{vocab.SPACE}+", ""))
    kept = F.length(strip(value))
    return F.when(kept > 0, F.struct((s + lead).alias("start"), (s + lead + kept).alias("end")))


def suspicious(text: Column, start: Column, end: Column, label_: Column) -> Column:
    """Whether a span looks cut off or is no instance of its label."""
    value = slice_text(text, start, end)
    bare = strip(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    before = F.when(start > 0, F.substring(text, start.cast("int"), F.lit(1))).otherwise("")
    after = F.substring(text, (end + 1).cast("int"), F.lit(1))
    return F.coalesce(
        F.when(bare == "", True)
        .when(label_ == "EMAIL", ~bare.rlike(vocab.WHOLE_EMAIL))
        .when(label_ == "IP_ADDRESS", ~bare.rlike(vocab.WHOLE_IP))
        .when(label_ == "CREDIT_CARD", (digits < 13) | before.rlike("^[0-9]$") | after.rlike("^[0-9]$"))
        .when(label_ == "ADDRESS", value.rlike("[0-9]$") & after.rlike("^[0-9]$")),
        F.lit(False),
    )


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(x: Column) -> Column:
    """The first index of the largest value, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def base_url(url: Column) -> Column:
    """Stripped, without slashes at the end, and with /v1 there; null if nothing is left."""
    bare = F.regexp_replace(strip(url), "/+$", "")
    return F.when(bare == "", None).when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1")))


def with_values_path(path: Column) -> Column:
    """Where a file goes when its spans get values: .with_values before the last ending."""
    ending = F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)
    return F.concat(F.left(path, F.length(path) - F.length(ending)), F.lit(".with_values"), ending)


def is_gguf(model: Column) -> Column:
    return F.lower(model).endswith(".gguf")


def no_quota(message: Column) -> Column:
    """Whether an error's text says that the quota is used up."""
    low = F.lower(message)
    return low.contains("insufficient_quota") | low.contains("exceeded your current quota")


def calls_needed(remaining: Column, batch: Column) -> Column:
    return F.ceil(remaining / batch)


def call_limit(remaining: Column, batch: Column) -> Column:
    """Calls to try where no limit is given: three times those needed."""
    return calls_needed(remaining, batch) * 3


def field_list(text: Column) -> Column:
    """Names between commas, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


#: Array elements that are cumulated together: appending copies what is there.
RUN = 256


def cumulated(sizes: Column) -> Column:
    """For each number the sum of those before it; in runs, so that the copying grows with the array and not with its square."""
    none = F.array().cast("array<bigint>")

    def sums(numbers: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("before"))
        return F.aggregate(numbers, first, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))

    def whole(given: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / RUN).cast("int")), lambda k: sums(F.slice(given, k * RUN + 1, RUN)))
        long = F.transform(F.array(runs), lambda r: F.flatten(F.zip_with(r, sums(F.transform(r, lambda x: x["sum"]))["before"], lambda x, at: F.transform(x["before"], lambda b: b + at))))[0]
        return F.when(F.size(given) > RUN, long).otherwise(sums(given)["before"])

    # made once, whatever makes the array
    return F.transform(F.array(sizes), whole)[0]
