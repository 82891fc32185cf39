"""What the queries start from, in both engines: gold spans that patterns find, and predictions derived from them.

No table holds annotations, so predictions are gold spans changed as a digest of their key says: kept, cut short,
begun early, relabelled or left out; every document whose id divides by 50 gets a false one.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared, vocab
from ..functions import columns as C
from ..operators import detect, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def gold(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """doc_id, label, start, end, value; with_text: and the document's text, while it is at hand."""
    if not with_text:
        return _held("gold", sf_dir, lambda: detect.pattern_spans(documents(spark, sf_dir), "doc_id", "text"))
    return detect.pattern_spans(documents(spark, sf_dir), "doc_id", "text", with_text=True)


def on_tokens(spark: SparkSession, sf_dir: str, containing: bool = False) -> DataFrame:
    """doc_id, label, start, end of gold and ts, te, its tokens or null: in the document's row."""
    rows = detect.listed(documents(spark, sf_dir), ["doc_id", "text"], "text").filter("size(spans) > 0")
    return tokens.spread(rows, ["doc_id"], "text", containing)


def sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """doc_id and n of all documents, and on_tokens() of the spans on tokens: from a table without texts, for which these are read once."""
    rows = detect.listed(documents(spark, sf_dir), ["doc_id", "text"], "text")
    rows = rows.select("doc_id", "spans", tokens.counted(F.col("text")).alias("n"), tokens.aligned(F.col("text"), F.col("spans.start"), F.col("spans.end")).alias("t"))
    rows = shared.written(rows.select("doc_id", "n", F.arrays_zip("spans", F.col("t.ts").alias("ts"), F.col("t.te").alias("te")).alias("spans")), "sized")
    placed = rows.select("doc_id", F.explode("spans").alias("z")).filter("z.ts is not null")
    return rows.select("doc_id", "n"), placed.select("doc_id", "z.spans.*", "z.ts", "z.te")


#: Gold and predictions that are read instead of made, by kind and folder; see once().
_once: ContextVar[dict | None] = ContextVar("once", default=None)


@contextlib.contextmanager
def once(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Inside, gold() and pred() of the folder are tables in the shared folder, made when they are first asked for."""
    token = _once.set({})
    try:
        yield
    finally:
        _once.reset(token)


def _held(kind: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    held = _once.get()
    if held is None:
        return make()
    if (kind, sf_dir) not in held:
        held[kind, sf_dir] = shared.written(make(), kind)
    return held[kind, sf_dir]


def _key(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("label"), F.lit(":"), F.col("start").cast("string"))


def pred(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """doc_id, label, start, end, value, score; with_text: and the document's text, while it is at hand."""
    return _pred(spark, sf_dir, True) if with_text else _held("pred", sf_dir, lambda: _pred(spark, sf_dir, False))


def _pred(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = detect.found(docs, ["doc_id", "text"], "text")
    rows = rows.withColumn("u", C.uniform(_key("pred"))).filter("u < 0.9")
    u = F.col("u")
    end = F.when((u >= 0.5) & (u < 0.6) & (F.col("end") - 2 > F.col("start")), F.col("end") - 2).otherwise(F.col("end"))
    start = F.when((u >= 0.6) & (u < 0.7), F.greatest(F.col("start") - 3, F.lit(0))).otherwise(F.col("start"))
    label = F.when((u >= 0.7) & (u < 0.8), "OTHER").otherwise(F.col("label"))
    rows = rows.select("doc_id", "text", label.alias("label"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.round("u", 6).alias("score"))
    false = docs.filter("doc_id % 50 = 0 and length(text) > 0").select("doc_id", "text", F.lit("OTHER").alias("label"), F.lit(0).cast("bigint").alias("start"), F.least(F.lit(5), F.length("text")).cast("bigint").alias("end"), F.lit(0.5).alias("score"))
    both = rows.unionByName(false)
    return both.select("doc_id", "label", "start", "end", C.slice_text(F.col("text"), F.col("start"), F.col("end")).alias("value"), "score", *(["text"] if with_text else []))


def scores() -> Column:
    """Of gold spans: by label."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in vocab.PATTERN_SCORES.items() for x in kv)), F.col("label"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import resolve

    return resolve.non_overlapping(gold(spark, sf_dir).withColumn("score", scores()), "doc_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_sql(table_: str, key: str, text: str) -> str:
    """CTEs up to hit(key, text, label, start, end)."""
    patterns = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in vocab.PATTERNS.items())
    return f"""
pat(label, p) AS (VALUES {patterns}),
parts AS (SELECT {key}, {text} AS text, label, string_split(regexp_replace({text}, p, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS q FROM {table_}, pat),
places AS (SELECT {key}, text, label, q, unnest(range(2, len(q) + 1)) AS i FROM parts WHERE len(q) > 1),
hit AS (SELECT {key}, text, label, CAST(list_sum(list_transform(q[1:i-1], lambda z: length(z))) - (i - 2) AS BIGINT) AS start,
  CAST(list_sum(list_transform(q[1:i-1], lambda z: length(z))) - (i - 2) + strpos(q[i], chr(2)) - 1 AS BIGINT) AS "end" FROM places)"""


GOLD = hits_sql("documents", "doc_id", "text") + """,
gold AS (SELECT doc_id, label, start, "end", substr(text, start + 1, "end" - start) AS value FROM hit)"""

UNIFORM = "('0x' || substr(md5({}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"

PRED = f""",
changed AS (SELECT *, {UNIFORM.format("'pred:' || doc_id || ':' || label || ':' || start")} AS u FROM hit),
predicted AS (
  SELECT doc_id, text, CASE WHEN u >= 0.7 AND u < 0.8 THEN 'OTHER' ELSE label END AS label,
    CASE WHEN u >= 0.6 AND u < 0.7 THEN greatest(start - 3, 0) ELSE start END AS start,
    CASE WHEN u >= 0.5 AND u < 0.6 AND "end" - 2 > start THEN "end" - 2 ELSE "end" END AS "end", round(u, 6) AS score FROM changed WHERE u < 0.9
  UNION ALL SELECT doc_id, text, 'OTHER', 0, least(5, length(text)), 0.5 FROM documents WHERE doc_id % 50 = 0 AND length(text) > 0),
pred AS (SELECT doc_id, label, start, "end", substr(text, start + 1, "end" - start) AS value, score FROM predicted)"""

SCORED = ", scored AS (SELECT *, CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.PATTERN_SCORES.items()) + " END::DOUBLE AS score FROM gold)"

#: kept(doc_id, label, start, end, score) of scored.
KEPT = SCORED + """,
listed AS (SELECT doc_id, list(struct_pack(rank := -score, size := start - "end", start := start, "end" := "end", label := label, score := score) ORDER BY -score, start - "end", start, "end", label) AS l FROM scored GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: greatest(k.start, x.start) < least(k."end", x."end"))) > 0 THEN acc ELSE list_append(acc, x) END, [l[1]]) AS l FROM listed),
kept AS (SELECT doc_id, k.label AS label, k.start AS start, k."end" AS "end", k.score AS score FROM (SELECT doc_id, unnest(l) AS k FROM folded))"""

TOKEN_PARTS = f"""
tparts AS (SELECT doc_id, string_split(regexp_replace(text, {_quoted(vocab.TOKEN)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS q FROM documents),
tplaces AS (SELECT doc_id, unnest(q) AS part, unnest(range(0, len(q))) AS i FROM tparts),
tsums AS (SELECT doc_id, part, i, sum(length(part) - CASE WHEN i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM tplaces),
toks AS (SELECT doc_id, i - 1 AS tok, CAST(pos AS BIGINT) AS s, CAST(pos + strpos(part, chr(2)) - 1 AS BIGINT) AS e FROM tsums WHERE i > 0)"""
