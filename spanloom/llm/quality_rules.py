"""5. Quality rules with robust multivariate outliers, in DataFrame operations only.

Each language and source has a location and a covariance of its own: those of the core, the share CORE of its rows
whose Mahalanobis distances under them are least (minimum covariance determinant). Concentration steps lead there:
distances under the last step's estimates give the next core. A source's core is taken together with PRIOR rows'
worth of its language's, whatever its size, so that nothing jumps where a source grows. It is sought from two
starts, its own medians and its language's, and the one with the lesser determinant holds.

Rows are counted and summed per bin of their distance, and the bins cumulated, so a group of any size is worked on
by all tasks and comes out as a few hundred rows. All groups, languages and starts take a step together.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, statistics

#: Share of the core: one half withstands the most outliers.
CORE = 0.5
#: Steps are taken until no group's log determinant moves by more, or so many have been.
TOLERANCE, STEPS = 0.05, 8
#: Rows' worth of a language's core in each of its sources'.
PRIOR = 50.0
#: Squared distance, in units of the median's expectation under a normal law, beyond which a row is rejected.
CUTOFF = 60.0
#: The least unit: a narrow core would reject what a normal law has in its tails.
LEAST_SCALE = 0.2
#: The base rules.
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Bins of squared distances for each factor e.
BINS = 24
#: Median of chi-squared with as many degrees of freedom as VECTOR has parts.
CHI2_MEDIAN = 4.351
#: The parts of a transformed vector, and the least standard deviation that each is given.
VECTOR = ("symbols", "word_length", "repeated_lines", "capitals", "bangs")
FLOORS = (0.05, 0.06, 0.10, 0.06, 0.05)
#: The statistics that are taken of a text.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")
_P = range(len(VECTOR))
_PAIRS = list(combinations_with_replacement(_P, 2))
_X = [f"x{i}" for i in _P]
_SUMS = [f"s{i}" for i in _P] + [f"s{i}_{j}" for i, j in _PAIRS]
_FACTORS = [f"m{i}" for i in _P] + [f"r{i}_{j}" for i in _P for j in range(i + 1)]
#: What a group is known by. kind: a whole language, or a source from its own start or from its language's.
_KEY = ["kind", "lang", "source"]
_LANGUAGE, _OWN, _LENT = 0, 1, 2


def vector(s: Column) -> list[Column]:
    """Shares, square roots of them, and the mean length of words; each with some words of a usual text added, so that short texts stay near the middle."""
    share = lambda part, whole, more: F.sqrt(s[part] / (s[whole] + F.lit(more)))
    return [share("n_symbols", "word_chars", 100.0), F.log((s["word_chars"] + 300.0) / (s["n_words"] + 50.0)), share("n_dup_lines", "n_lines", 10.0), share("n_capitals", "word_chars", 100.0), share("n_bangs", "word_chars", 100.0)]


def _square(x: list[str], of: str = "") -> str:
    """SQL of the squared distance under the columns m{i} and r{i}_{j}, rows of the inverse of the Cholesky factor; ``of``: the struct they are in."""
    parts = ["(" + " + ".join(f"{of}r{i}_{j} * ({x[j]} - {of}m{j})" for j in range(i + 1)) + ")" for i in _P]
    return " + ".join(f"{part} * {part}" for part in parts)


def _bin(square: str) -> str:
    return f"cast(greatest(floor(ln({square} + 1e-9D) * {BINS}), {-21 * BINS}) as int)"


def _up_to(binned: DataFrame, key: list[str], share: float, sums: list[str]) -> DataFrame:
    """For each key, the first bin up to which there is that share of its rows, and the sums up to there."""
    of = f"partition by {', '.join(key)}"
    upward = [f"sum({c}) over ({of} order by bin rows unbounded preceding) as {c}" for c in ("n", *sums)]
    out = binned.selectExpr(*key, "bin", f"sum(n) over ({of}) as total", *upward).filter(f"n >= ceil(total * {share}D)")
    return out.groupBy(*key).agg(F.min_by(F.struct("n", "total", *sums, "bin"), "bin").alias("of")).select(*key, "of.*")


def _factored(sums: DataFrame, keep: list[str]) -> DataFrame:
    """keep, m{i}, r{i}_{j} and log_det from the counts and sums of a core, by Cholesky's method a column at a time."""
    size = len(VECTOR)
    cov = lambda i, j: f"greatest(s{i}_{i} / n - s{i} / n * s{i} / n, 0D) + {FLOORS[i] ** 2}D" if i == j else f"s{j}_{i} / n - s{i} / n * s{j} / n"
    out = sums.selectExpr(*keep, *(f"s{i} / n as m{i}" for i in _P), *(f"{cov(i, j)} as c{i}_{j}" for i in _P for j in range(i + 1)))
    rest = lambda i, j: f"(c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + ")"
    for j in _P:
        out = out.selectExpr("*", f"sqrt(greatest({rest(j, j)}, 1e-12D)) as l{j}_{j}")
        if j + 1 < size:
            out = out.selectExpr("*", *(f"{rest(i, j)} / l{j}_{j} as l{i}_{j}" for i in range(j + 1, size)))
    out = out.selectExpr("*", *(f"1 / l{i}_{i} as r{i}_{i}" for i in _P))
    for off in range(1, size):
        inverse = lambda i, j: "(0D" + "".join(f" - l{i}_{k} * r{k}_{j}" for k in range(j, i)) + f") / l{i}_{i}"
        out = out.selectExpr("*", *(f"{inverse(j + off, j)} as r{j + off}_{j}" for j in range(size - off)))
    return out.selectExpr(*keep, *_FACTORS, f"2 * ({' + '.join(f'ln(l{i}_{i})' for i in _P)}) as log_det")


def _start(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """For each key, its parts' medians and, as a diagonal factor, the medians of the distances from them (at least the floors)."""

    def medians(df: DataFrame) -> DataFrame:
        long = df.select(*_KEY, F.posexplode(F.array(*_X)).alias("part", "value"))
        binned = long.select(*_KEY, "part", F.floor(F.col("value") * 2000).cast("int").alias("bin")).groupBy(*_KEY, "part", "bin").agg(F.count(F.lit(1)).alias("n"))
        found = _up_to(binned, [*_KEY, "part"], 0.5, []).select(*_KEY, "part", ((F.col("bin") + 0.5) / 2000).alias("value"))
        return found.groupBy(*_KEY).agg(*(F.max(F.when(F.col("part") == i, F.col("value"))).alias(f"m{i}") for i in _P))

    middle = scratch.table(medians(rows), "middles")
    spread = medians(rows.join(middle, _KEY).select(*_KEY, *(F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in _P)))
    spread = spread.select(*_KEY, *((1.0 / F.greatest(F.col(f"m{i}") * 1.4826, F.lit(FLOORS[i]))).alias(f"w{i}") for i in _P))
    both = middle.join(spread, _KEY)
    return both.select(*_KEY, *(f"m{i}" for i in _P), *((F.col(f"w{i}") if i == j else F.lit(0.0)).alias(f"r{i}_{j}") for i in _P for j in range(i + 1)), F.lit(None).cast("double").alias("log_det"))


def _of_kinds(rows: DataFrame, kinds: dict[int, bool]) -> DataFrame:
    """Each row once for each kind; whether its source is part of the key."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), (F.col("source") if own else F.lit("")).alias("source")) for k, own in kinds.items()))
    return rows.select("lang", *_X, F.explode(each).alias("key")).select("key.kind", "lang", "key.source", *_X)


def _step(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Each key's next factors, from the core under the current ones; ``unit``: what their distances are divided by."""
    binned = rows.join(current, _KEY).selectExpr(*_KEY, f"{_bin(_square(_X))} as bin", *_X).groupBy(*_KEY, "bin")
    binned = binned.agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"sum(x{i}) as s{i}") for i in _P), *(F.expr(f"sum(x{i} * x{j}) as s{i}_{j}") for i, j in _PAIRS))
    core = _up_to(binned, _KEY, CORE, _SUMS).selectExpr("*", f"exp((bin + 0.5D) / {BINS}) / {CHI2_MEDIAN}D as unit", f"if(kind = {_LANGUAGE}, 0D, {PRIOR}D) as w")
    # a source's rows come with the language's, as PRIOR rows
    core = core.selectExpr("*", f"max(if(kind = {_LANGUAGE}, struct(unit, n, {', '.join(_SUMS)}), null)) over (partition by lang) as lent")
    core = core.selectExpr(*_KEY, "n + w as n", *(f"{c} + w * lent.{c} / lent.n as {c}" for c in _SUMS), "(total * unit + w * lent.unit) / (total + w) as unit")
    return _factored(core, [*_KEY, "unit"])


def fit(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """lang, source and factors (m{i}, r{i}_{j}, unit, log_det) of the groups of ``rows`` (lang, source, x{i})."""
    start = _start(_of_kinds(rows, {_LANGUAGE: False, _OWN: True}), scratch)
    lent = start.filter(F.col("kind") == _LANGUAGE).drop("kind", "source")
    lent = start.filter(F.col("kind") == _OWN).select("lang", "source").join(lent, "lang").select(F.lit(_LENT).alias("kind"), "lang", "source", *_FACTORS, "log_det")
    current = scratch.table(start.union(lent), "factors")
    rows = _of_kinds(rows, {_LANGUAGE: False, _OWN: True, _LENT: True})
    for _ in range(STEPS):
        after = scratch.table(_step(rows, current), "factors")
        moved = after.join(current.select(*_KEY, F.col("log_det").alias("before")), _KEY).agg(F.max(F.abs(F.col("log_det") - F.col("before"))), F.count("before")).first()
        settled = moved[1] > 0 and moved[0] <= TOLERANCE
        # the units are those of the distances under the factors that the step began with
        found = current.drop("log_det", "unit").join(after.select(*_KEY, "unit", F.col("log_det")), _KEY)
        if settled:
            break
        current = after
    best = F.min_by(F.struct(*_FACTORS, F.greatest("unit", F.lit(LEAST_SCALE)).alias("unit"), "log_det"), F.struct("log_det", "kind"))
    return scratch.table(found.filter(F.col("kind") != _LANGUAGE).groupBy("lang", "source").agg(best.alias("factors")), "factors")


def _judged(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, k1, k2 and verdict of each row of docs, and the tables that they read from, which hold no texts."""
    text, cell = F.col("text").cast("string"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select("doc_id", *common.row_key(F.col("doc_id"), text, F.col("lang"), F.col("source")), cell("lang"), cell("source"), text.alias("text"))
    table = scratch.table(statistics.add(rows, "text", "s", NAMES).select("doc_id", "k1", "k2", "lang", "source", "s"), "statistics")
    s = F.col("s")
    failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
    rows = table.select("*", *(v.alias(x) for v, x in zip(vector(s), _X, strict=True)))
    factors = fit(rows.filter(~failed).select("lang", "source", *_X), scratch)
    # every row gets its group's numbers, a table of a row for each group, and is judged where it stands
    distance = F.when(~failed, F.expr(_square(_X, "factors.")) / F.col("factors.unit"))
    verdict = F.struct(*(s[k].alias(k) for k in NAMES), failed.alias("base_failed"), distance.alias("distance"), (~failed & (F.coalesce(distance, F.lit(0.0)) <= CUTOFF)).alias("kept"))
    return rows.join(factors, ["lang", "source"], "left").select("doc_id", "k1", "k2", verdict.alias("verdict")), [table, factors]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id and verdict of each row of docs: the statistics, base_failed, distance (null where base_failed) and kept.

    A null text is an empty one and fails the base rules; a text of any length is counted as a whole. A null lang or
    source counts as an empty one. Rows that repeat get the same verdict; no rows give none. Where a language has
    one row alone, that row is its own middle and kept. Columns of docs besides (doc_id, text, lang, source) are
    left out. The result reads from tables of statistics in the shared folder.
    """
    with common.scratch(docs.sparkSession) as scratch:
        found, tables = _judged(docs, scratch)
        for table in tables:
            scratch.keep(table)
        return found.select("doc_id", "verdict")


def verdicts(docs: DataFrame, name: str) -> DataFrame:
    """docs with the struct column ``name`` of what judged() gives for each row."""
    with common.scratch(docs.sparkSession) as scratch:
        found, _ = _judged(docs, scratch)
        found = scratch.table(found.groupBy("k1", "k2").agg(F.first("verdict").alias(name)), "verdicts")
        scratch.keep(found)
        return common.with_rows(docs, found, name, "lang", "source")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(common.load(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"verdict.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are kept. Rows that repeat stay or go together; no rows give none."""
    name = statistics.fresh(docs, "verdict")
    return verdicts(docs, name).filter(F.col(name)["kept"]).drop(name)
