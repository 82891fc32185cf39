"""Supervision, sampling, calibration and cost queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared, vocab
from ..functions import columns as C
from ..operators import costs, detect, labelling, negatives, supervise, tokens, vectors
from . import fixtures as X
from . import spans as S

#: Tokens of a candidate at most.
MOST = 12


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with spans and an array of their tokens' tags."""
    rows = detect.listed(X.documents(spark, sf), ["doc_id", "text"], "text").filter("size(spans) > 0")
    return rows.select("doc_id", tokens.bio(F.col("text"), F.col("spans.start"), F.col("spans.end")).alias("tags"))


def bio_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of the tokens of documents with spans, where they aren't O."""
    rows = _tagged(spark, sf).select("doc_id", F.transform("tags", lambda t, i: F.struct(i.cast("bigint").alias("tok"), t.alias("tag"))).alias("tags"))
    rows = rows.select("doc_id", F.explode(F.filter("tags", lambda t: t["tag"] > tokens.O)).alias("t"))
    return rows.select("doc_id", "t.tok", F.when(F.col("t.tag") == tokens.B, "B").otherwise("I").alias("tag"))


def bio_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf).select("doc_id", tokens.runs(F.col("tags")).alias("r"))
    return rows.select("doc_id", F.explode(F.arrays_zip("r.ts", "r.te")).alias("r")).select("doc_id", "r.ts", "r.te")


def bio_specials(spark: SparkSession, sf: str) -> DataFrame:
    """Proposal tags of all documents' tokens with a special one at both ends, counted by tag; specials are -100."""
    rows = detect.listed(X.documents(spark, sf), ["doc_id", "text"], "text")
    rows = rows.select("doc_id", F.explode(tokens.bio(F.col("text"), F.col("spans.start"), F.col("spans.end"), specials=True)).alias("tag"))
    return rows.groupBy("doc_id", F.col("tag").cast("bigint").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans as items and spans: two thirds of them as both, with another label as span now and then."""
    rows = X.gold(spark, sf).withColumn("u", C.uniform(X._key("origin")))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "label")
    rows = rows.withColumn("ord", F.row_number().over(w).cast("bigint"))
    items = rows.filter("u < 0.7").select("doc_id", "start", "end", "label", "ord", F.lit("item").alias("origin"), F.when(F.col("u") < 0.2, "KEEP").when(F.col("u") < 0.4, "REDACT").alias("sensitivity"))
    spans = rows.filter("u > 0.3").select("doc_id", "start", "end", F.when(F.col("u") < 0.5, "OTHER").otherwise(F.col("label")).alias("label"), "ord", F.lit("span").alias("origin"), F.lit(None).cast("string").alias("sensitivity"))
    return items.unionByName(spans)


def supervision_types(spark: SparkSession, sf: str) -> DataFrame:
    return supervise.merged_types(_annotations(spark, sf), "doc_id")


def supervision_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _annotations(spark, sf)
    w = Window.partitionBy("doc_id").orderBy("start", "end", "label")
    over = X.gold(spark, sf).withColumn("ord", F.row_number().over(w).cast("bigint")).filter(C.uniform(X._key("over")) < 0.2)
    over = over.select("doc_id", "start", "end", "ord", F.lit("KEEP").alias("sensitivity"))
    return supervise.merged_sensitivity(rows, over, "doc_id")


def gold_merge(spark: SparkSession, sf: str) -> DataFrame:
    return supervise.first_merged(_annotations(spark, sf), "doc_id", ["start", "end", "label"]).select("doc_id", "start", "end", "label", "origin")


def _placed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans on tokens, and the candidates of at most MOST tokens that touch one: all others are NONE and KEEP."""
    rows = detect.listed(X.documents(spark, sf), ["doc_id", "text"], "text").filter("size(spans) > 0")
    rows = rows.select("doc_id", "text", "spans", (tokens.counted(F.col("text")) - 1).alias("last"))
    # a few rows a document, read several times
    found = shared.written(tokens.spread(rows, ["doc_id", "last"], "text").filter("ts is not null"), "placed")
    gold = found.select("doc_id", "ts", "te", "label")
    near = found.select("doc_id", "last", F.col("ts").alias("gs"), F.explode(F.sequence(F.greatest(F.col("ts") - (MOST - 1), F.lit(0)), "te")).alias("ts"))
    cands = near.select("doc_id", "ts", F.explode(F.sequence(F.greatest("ts", "gs"), F.least(F.col("ts") + (MOST - 1), F.col("last")))).alias("te"))
    return gold, cands.distinct()


def soft_type_targets(spark: SparkSession, sf: str) -> DataFrame:
    gold, cands = _placed(spark, sf)
    out = supervise.soft_types(cands, gold, "doc_id")
    return out.withColumn("weight", F.round("weight", 6))


def soft_redaction_targets(spark: SparkSession, sf: str) -> DataFrame:
    gold, cands = _placed(spark, sf)
    sens = gold.select("doc_id", "ts", "te", F.when(F.col("label") == "PHONE", "KEEP").otherwise("REDACT").alias("label"))
    like = gold.filter("label = 'IP_ADDRESS'")
    out = supervise.soft_redaction(cands, sens, like, "doc_id")
    return out.select("doc_id", "ts", "te", F.round("redact", 6).alias("redact"), F.round("keep", 6).alias("keep"))


def calibrate_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    key = ["doc_id", "label", "start", "end"]
    gold = X.gold(spark, sf)
    scored = X.pred(spark, sf).join(gold.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left")
    scored = scored.select("label", "score", F.coalesce("hit", F.lit(False)).alias("hit"))
    support = gold.select(*key).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("support"))
    out = supervise.thresholds(scored, support, least=20)
    return out.withColumn("f1", F.round("f1", 6))


def none_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """The share of candidates without a gold span, and the share of these to keep for one of a tenth."""
    gold = _gold_token_spans(spark, sf).filter("te - ts < 12")
    n = X.documents(spark, sf).select(detect.candidate_count(tokens.counted(F.col("text")), 12).alias("c")).agg(F.sum("c").alias("candidates"))
    out = n.crossJoin(gold.select("doc_id", "ts", "te").distinct().agg(F.count(F.lit(1)).alias("positives")))
    share = 1 - F.col("positives") / F.col("candidates")
    return out.select("candidates", "positives", F.round(share, 9).alias("prevalence"), F.round(supervise.keep_probability(F.lit(0.1), share), 9).alias("keep_probability"))


def _gold_token_spans(spark: SparkSession, sf: str) -> DataFrame:
    return X.on_tokens(spark, sf).filter("ts is not null")


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """For each label the gold spans that candidates of at most 12 tokens can reach."""
    rows = _gold_token_spans(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("te") - F.col("ts") < 12).alias("reachable"))
    return rows.withColumn("rate", F.round(F.col("reachable") / F.col("total"), 6))


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its number of tokens and its gold spans on tokens."""
    docs, found = X.sized(spark, sf)
    gold = labelling.placed(found, "doc_id", "label", F.struct("label")).withColumnRenamed("gold", "types")
    return docs.join(gold, "doc_id", "left").withColumn("types", F.coalesce("types", F.array().cast(labelling.PLACED)))


def negative_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of all documents that a gold span stands at, and a fifth of the others, counted by document and label."""
    out = labelling.sampled(_types(spark, sf), "doc_id", 0.2, MOST)
    return out.groupBy("doc_id", F.coalesce("label", F.lit("NONE")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.sum("te").alias("sum_te"))


def negative_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Negatives of all documents by budget, counted by kind: hard ones share a token with a gold span; documents without gold have a budget of their own."""
    rows = labelling.budgeted(_types(spark, sf), "doc_id", MOST)
    return rows.groupBy("doc_id", "positive", "hard").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.sum("te").alias("sum_te"))


def negative_share(spark: SparkSession, sf: str) -> DataFrame:
    """All positives of all documents and a twentieth of each document's other candidates, counted by kind."""
    rows = labelling.share(_types(spark, sf), "doc_id", 0.05, MOST)
    return rows.groupBy("doc_id", "positive", "hard").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.sum("te").alias("sum_te"))


def split_train_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Nine in ten documents of each source for training, by their digests' order."""
    return supervise.split(X.documents(spark, sf).select("doc_id", "source"), "source", "doc_id", 9, 10)


def span_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as the vectors of sixteen tokens, and two spans on each: their vectors' sums."""
    rows = X.table(spark, sf, "embeddings")
    hidden = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.transform(F.slice("embedding", k * 4 + 1, 4), lambda v: v.cast("double")))
    ts = F.array(F.col("vec_id") % 9, F.lit(0).cast("long"))
    docs = rows.select("vec_id", hidden.alias("hidden"), ts.alias("ts"), F.array(F.col("vec_id") % 9 + F.col("vec_id") % 8, F.lit(15).cast("long")).alias("te"))
    spans = docs.select("vec_id", F.explode(F.arrays_zip("ts", "te")).alias("s")).select("vec_id", "s.ts", "s.te")
    made = vectors.represented(docs, spans, "vec_id", [[float(k)] for k in range(4)])
    total = lambda a, n: F.round(F.aggregate(F.slice("vector", a, n), F.lit(0.0), lambda acc, v: acc + v), 6)
    return made.select("vec_id", "ts", "te", total(1, 4).alias("first"), total(5, 4).alias("last"), total(9, 4).alias("mean"), F.get("vector", F.lit(12)).alias("width"))


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "embeddings")
    # as many logits as there are labels, each the sum of its share of the whole embedding
    share = lambda k: F.aggregate(F.filter("embedding", lambda _, i: i % len(vocab.TRAINING_LABELS) == k), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(len(vocab.TRAINING_LABELS) - 1)), share).alias("x"))


def softmax_argmax(spark: SparkSession, sf: str) -> DataFrame:
    p = C.softmax(F.col("x"))
    return _logits(spark, sf).select("vec_id", F.round(F.array_max(p), 6).alias("confidence"), C.argmax(F.col("x")).alias("predicted"))


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """Mean masked and soft cross entropies of embeddings taken as logits, every fifth row masked."""
    rows = _logits(spark, sf).withColumn("p", C.softmax(F.col("x"))).withColumn("y", F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label") % 14))
    target = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.when(i == F.col("y"), 0.8).otherwise(F.when(i == 0, 0.2).otherwise(0.0)))
    soft = F.when(F.col("y") != -100, supervise.soft_cross_entropy(F.col("p"), target))
    hard = supervise.cross_entropy(F.col("p"), F.col("y"))
    return rows.agg(F.round(F.coalesce(F.avg(hard), F.lit(0.0)), 6).alias("hard"), F.round(F.coalesce(F.avg(soft), F.lit(0.0)), 6).alias("soft"), F.count(hard).alias("n"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as calls to models."""
    models = ["gpt-5", "GPT-5-mini ", "gpt-5-pro", "gpt-5.4", "unheard-of"]
    pick = F.element_at(F.array(*map(F.lit, models)), (F.col("conv_id") % 5 + 1).cast("int"))
    n = F.length("text").cast("bigint")
    return X.table(spark, sf, "conversations").select("conv_id", "turn", pick.alias("model"), (n * 3000).alias("input_tokens"), (n * 100 * (F.col("turn") + 1)).cast("bigint").alias("cached_tokens"), (n * 10).alias("output_tokens"))


def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = costs.priced(_calls(spark, sf))
    return rows.select("conv_id", "turn", "model", F.round("cost_usd", 9).alias("cost_usd"))


def budget_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """For each conversation the calls that a budget of 5 dollars allows, and the first that it doesn't."""
    rows = costs.priced(_calls(spark, sf)).withColumn("micros", F.round(F.col("cost_usd") * 1e6).cast("bigint"))
    out = costs.budgeted(rows, "conv_id", ["turn"], "micros", 5_000_000)
    return out.groupBy("conv_id").agg(F.count_if("within").alias("n_within"), F.min(F.when(~F.col("within"), F.col("turn"))).alias("first_beyond"), F.sum(F.when(F.col("within"), F.col("micros")).otherwise(0)).alias("spent_micros"))


QUERIES = {
    f.__name__: f
    for f in (bio_labels, bio_decode, bio_specials, supervision_types, supervision_sensitivity, gold_merge, soft_type_targets, soft_redaction_targets, calibrate_thresholds, none_prevalence, reachability, negative_sampling, negative_budgets, negative_share, split_train_valid, span_vectors, softmax_argmax, losses, usage_cost, budget_cutoff)
}

_T = S._TOKS_OF_GOLD
_PLACED = ', placed AS (SELECT g.doc_id, g.label, g.start, g."end", min(tok) AS ts, max(tok) AS te FROM gold g JOIN toks t ON g.doc_id = t.doc_id AND greatest(g.start, s) < least(g."end", e) GROUP BY ALL)'
_CANDS = ", near AS (SELECT doc_id, ts AS gs, unnest(range(greatest(ts - 11, 0), te + 1)) AS ts FROM placed), lasts AS (SELECT doc_id, max(tok) AS lst FROM toks GROUP BY doc_id), cands AS (SELECT DISTINCT doc_id, ts, te FROM (SELECT doc_id, ts, unnest(range(greatest(ts, gs), least(ts + 11, lst) + 1)) AS te FROM near JOIN lasts USING (doc_id)))"
_EVERY = f", sizes AS (SELECT doc_id, len(regexp_extract_all(text, {S._quoted(S.vocab.TOKEN)})) AS n FROM documents), firsts AS (SELECT doc_id, n, unnest(range(0, n)) AS ts FROM sizes), every AS (SELECT doc_id, ts, unnest(range(ts, least(ts + 12, n))) AS te FROM firsts)"


def _placed_draws(name: str, rows: str) -> str:
    """CTE drawn: rows (doc_id, n, ts, te, ...) with j, where the permutation keyed by name and document draws them."""
    steps = [f"""{name}0 AS (SELECT *, (te - ts) * n - (te - ts) * (te - ts - 1) // 2 + ts AS rk, list_filter(range(1, 17), lambda m: (1::BIGINT << (2 * m)) >= least(n, {MOST}) * n - least(n, {MOST}) * (least(n, {MOST}) - 1) // 2)[1] AS b, ('0x' || substr(md5('{name}:' || doc_id), 1, 7))::BIGINT AS kd FROM {rows}),
{name}1 AS (SELECT *, rk >> b AS l, rk & ((1::BIGINT << b) - 1) AS r FROM {name}0)"""]
    for k, a in enumerate(reversed(negatives.ROUNDS)):
        steps.append(f"{name}{k + 2} AS (SELECT * EXCLUDE (l, r), xor(r, ((l * {a} + kd) % {negatives.PRIME}) & ((1::BIGINT << b) - 1)) AS l, l AS r FROM {name}{k + 1})")
    return ",\n".join([*steps, f"drawn AS (SELECT *, (l << b) | r AS j FROM {name}{len(negatives.ROUNDS) + 1})"])


_KINDS = """, ex AS (SELECT DISTINCT doc_id, ts, te, true AS p FROM placed), ha AS (SELECT DISTINCT c.doc_id, c.ts, c.te, true AS h FROM every c JOIN placed g ON c.doc_id = g.doc_id AND g.ts <= c.te AND c.ts <= g.te),
of_ AS (SELECT doc_id, count(*) AS of_ FROM ex WHERE te - ts < 12 GROUP BY doc_id),
q AS (SELECT doc_id, n, ts, te, coalesce(p, false) AS positive, coalesce(h, false) AS hard, coalesce(of_, 0) AS of_ FROM every JOIN sizes USING (doc_id) LEFT JOIN ex USING (doc_id, ts, te) LEFT JOIN ha USING (doc_id, ts, te) LEFT JOIN of_ USING (doc_id)),
"""
_IOU = """
, touch AS (SELECT c.doc_id, c.ts, c.te, g.label, g.ts AS gs, g.te AS ge FROM cands c JOIN {0} g ON c.doc_id = g.doc_id AND g.ts <= c.te AND c.ts <= g.te),
u AS (SELECT doc_id, ts, te, label, min((gs, ge, label)) AS first, list_distinct(flatten(list(range(gs, ge + 1)))) AS l FROM touch GROUP BY doc_id, ts, te, label),
iou AS (SELECT doc_id, ts, te, label, first, len(list_filter(l, lambda x: x >= ts AND x <= te)) / (te - ts + 1 + len(l) - len(list_filter(l, lambda x: x >= ts AND x <= te))) AS iou FROM u)"""
_BIO = """, h AS (SELECT t.doc_id, tok, g.start, g."end", CASE WHEN tok = min(tok) OVER (PARTITION BY t.doc_id, g.start, g."end") THEN 'B' ELSE 'I' END AS tag FROM toks t JOIN (SELECT DISTINCT doc_id, start, "end" FROM gold) g ON g.doc_id = t.doc_id AND greatest(s, g.start) < least(e, g."end")),
tags AS (SELECT doc_id, tok, arg_max(tag, (start, "end")) AS tag FROM h GROUP BY doc_id, tok)"""
_U = X.UNIFORM.format
_ANN = f""", r AS (SELECT *, {_U("'origin:' || doc_id || ':' || label || ':' || start")} AS u, {_U("'over:' || doc_id || ':' || label || ':' || start")} AS o, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label) AS ord FROM gold),
ann AS (SELECT doc_id, start, "end", label, ord, 'item' AS origin, CASE WHEN u < 0.2 THEN 'KEEP' WHEN u < 0.4 THEN 'REDACT' END AS sensitivity FROM r WHERE u < 0.7
  UNION ALL SELECT doc_id, start, "end", CASE WHEN u < 0.5 THEN 'OTHER' ELSE label END, ord, 'span', NULL FROM r WHERE u > 0.3)"""
_LOGITS = "WITH l AS (SELECT vec_id, label, list_transform(range(0, 14), lambda k: list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_filter(range(1, len(embedding) + 1), lambda i: (i - 1) % 14 = k), lambda i: embedding[i]::DOUBLE)), lambda a, v: a + v)) AS x FROM embeddings), m AS (SELECT *, list_max(x) AS top FROM l), e AS (SELECT *, list_transform(x, lambda v: exp(v - top)) AS ex FROM m), p AS (SELECT *, list_sum(ex) AS z FROM e)"
_CALLS = """WITH c AS (SELECT conv_id, turn, ['gpt-5', 'GPT-5-mini ', 'gpt-5-pro', 'gpt-5.4', 'unheard-of'][CAST(conv_id % 5 + 1 AS INT)] AS model, length(text) * 3000 AS i, least(length(text) * 100 * (turn + 1), length(text) * 3000) AS k, length(text) * 10 AS o FROM conversations),
p AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN 1.25 WHEN 2 THEN 15.0 WHEN 3 THEN CASE WHEN i > 272000 THEN 5.0 ELSE 2.5 END ELSE 0.25 END::DOUBLE AS pi,
  CASE conv_id % 5 WHEN 0 THEN 0.125 WHEN 2 THEN 15.0 WHEN 3 THEN CASE WHEN i > 272000 THEN 0.5 ELSE 0.25 END ELSE 0.025 END::DOUBLE AS pk,
  CASE conv_id % 5 WHEN 0 THEN 10.0 WHEN 2 THEN 120.0 WHEN 3 THEN CASE WHEN i > 272000 THEN 22.5 ELSE 15.0 END ELSE 2.0 END::DOUBLE AS po FROM c),
d AS (SELECT *, (greatest(i - k, 0) * pi + k * pk + o * po) / 1e6 AS cost FROM p)"""

ORACLES = {
    "bio_labels": _T + _BIO + " SELECT * FROM tags",
    "bio_specials": "WITH" + X.GOLD + "," + X.TOKEN_PARTS + _BIO + ", a AS (SELECT doc_id, CASE tag WHEN 'B' THEN 1 WHEN 'I' THEN 2 ELSE 0 END AS tag FROM toks LEFT JOIN tags USING (doc_id, tok) UNION ALL SELECT doc_id, unnest([-100, -100]) FROM documents) SELECT doc_id, tag::BIGINT AS tag, count(*) AS n FROM a GROUP BY ALL",
    "bio_decode": _T + _BIO + ", a AS (SELECT t.doc_id, t.tok, coalesce(tag, 'O') AS tag FROM toks t LEFT JOIN tags g ON t.doc_id = g.doc_id AND t.tok = g.tok), b AS (SELECT *, sum(CASE WHEN tag = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY tok) AS run FROM a) SELECT doc_id, min(tok) AS ts, max(tok) AS te FROM b WHERE tag <> 'O' GROUP BY doc_id, run HAVING bool_or(tag = 'B')",
    "supervision_types": "WITH" + X.GOLD + _ANN + ", q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, \"end\" ORDER BY origin = 'item' DESC, CASE WHEN origin = 'item' THEN -ord ELSE ord END) AS rn FROM ann) SELECT doc_id, start, \"end\", label FROM q WHERE rn = 1",
    "supervision_sensitivity": "WITH" + X.GOLD + _ANN + """, said AS (SELECT doc_id, start, "end", sensitivity, 0 AS side, ord FROM ann WHERE sensitivity IS NOT NULL UNION ALL SELECT doc_id, start, "end", 'KEEP', 1, ord FROM r WHERE o < 0.2),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY side DESC, ord DESC) AS rn FROM said)
SELECT doc_id, start, "end", sensitivity FROM w WHERE rn = 1 UNION ALL SELECT DISTINCT doc_id, start, "end", 'REDACT' FROM ann WHERE doc_id NOT IN (SELECT doc_id FROM said)""",
    "gold_merge": "WITH" + X.GOLD + _ANN + ', q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end", label ORDER BY origin <> \'item\', ord) AS rn FROM ann) SELECT doc_id, start, "end", label, origin FROM q WHERE rn = 1',
    "soft_type_targets": _T + _PLACED + _CANDS + _IOU.format("placed") + """, ex AS (SELECT doc_id, ts, te, max(label) AS exact FROM placed GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ts, te ORDER BY iou DESC, first) AS rn FROM iou)
SELECT c.doc_id, c.ts, c.te, coalesce(exact, b.label, 'NONE') AS best_label, round(CASE WHEN exact IS NOT NULL OR b.label IS NULL THEN 1.0::DOUBLE ELSE iou END, 6) AS weight
FROM cands c LEFT JOIN ex USING (doc_id, ts, te) LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (doc_id, ts, te)""",
    "soft_redaction_targets": _T + _PLACED + _CANDS + ", sens AS (SELECT doc_id, ts, te, CASE WHEN label = 'PHONE' THEN 'KEEP' ELSE 'REDACT' END AS label FROM placed)" + _IOU.format("sens") + """, ex AS (SELECT doc_id, ts, te, max(label) AS exact FROM sens GROUP BY ALL), li AS (SELECT DISTINCT doc_id, ts, te, true AS like_ FROM placed WHERE label = 'IP_ADDRESS'),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ts, te ORDER BY iou DESC, first) AS rn FROM iou),
q AS (SELECT c.doc_id, c.ts, c.te, CASE WHEN like_ THEN 0.8::DOUBLE WHEN exact IS NOT NULL THEN CASE WHEN exact = 'REDACT' THEN 1.0 ELSE 0.0 END WHEN b.label = 'REDACT' THEN iou WHEN b.label = 'KEEP' THEN 1 - iou ELSE 0.0 END AS redact
FROM cands c LEFT JOIN li USING (doc_id, ts, te) LEFT JOIN ex USING (doc_id, ts, te) LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (doc_id, ts, te))
SELECT doc_id, ts, te, round(redact, 6) AS redact, round(1 - redact, 6) AS keep FROM q""",
    "calibrate_thresholds": "WITH" + X.GOLD + X.PRED + """, gs AS (SELECT DISTINCT doc_id, label, start, "end" FROM gold), sup AS (SELECT label, count(*) AS support FROM gs GROUP BY label),
sc AS (SELECT p.label, p.score, g.doc_id IS NOT NULL AS hit FROM pred p LEFT JOIN gs g USING (doc_id, label, start, "end")),
pt AS (SELECT label, score, sum(hit::INT) AS h, count(*) AS n FROM sc GROUP BY ALL),
cu AS (SELECT label, score, sum(h) OVER w AS tp, sum(n) OVER w AS al FROM pt WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
f AS (SELECT c.*, support, tp / (al + 1e-9) AS p, tp / (tp + greatest(support - tp, 0) + 1e-9) AS r FROM cu c JOIN sup USING (label)),
b AS (SELECT label, score, round(2 * p * r / (p + r + 1e-9), 9) AS f1, max(al) OVER (PARTITION BY label) AS ex FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, score DESC) AS rn FROM b)
SELECT label, support, CAST(coalesce(ex, 0) AS BIGINT) AS examples, CASE WHEN support < 20 OR ex IS NULL THEN 0.2::DOUBLE ELSE score END AS threshold, round(CASE WHEN support < 20 OR ex IS NULL THEN 0.0::DOUBLE ELSE f1 END, 6) AS f1, support < 20 OR ex IS NULL AS default_used FROM sup LEFT JOIN (SELECT * FROM k WHERE rn = 1) USING (label)""",
    "none_prevalence": _T + _PLACED + f""", n AS (SELECT len(regexp_extract_all(text, {S._quoted(S.vocab.TOKEN)})) AS n FROM documents), c AS (SELECT CAST(sum(least(n, 12) * n - least(n, 12) * (least(n, 12) - 1) // 2) AS BIGINT) AS candidates FROM n), q AS (SELECT count(*) AS positives FROM (SELECT DISTINCT doc_id, ts, te FROM placed WHERE te - ts < 12))
SELECT candidates, positives, round(1 - positives / candidates, 9) AS prevalence, round(least(1.0, 0.1 * (positives / candidates) / ((1 - positives / candidates) * 0.9)), 9) AS keep_probability FROM c, q""",
    "reachability": _T + _PLACED + ", c AS (SELECT label, count(*) AS total, count(*) FILTER (te - ts < 12) AS reachable FROM placed GROUP BY label) SELECT *, round(reachable / total, 6) AS rate FROM c",
    "negative_sampling": _T + _PLACED + _EVERY + f", ex AS (SELECT doc_id, ts, te, max(label) AS label FROM placed GROUP BY ALL) SELECT doc_id, coalesce(label, 'NONE') AS label, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts, CAST(sum(te) AS BIGINT) AS sum_te FROM every LEFT JOIN ex USING (doc_id, ts, te) WHERE label IS NOT NULL OR {_U("'neg:' || doc_id || ':' || ts || ':' || te")} <= 0.2 GROUP BY ALL",
    "negative_budgets": _T + _PLACED + _EVERY + _KINDS + _placed_draws("budget", "q") + """,
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, positive, hard ORDER BY j) AS k FROM drawn)
SELECT doc_id, positive, hard, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts, CAST(sum(te) AS BIGINT) AS sum_te FROM k WHERE positive OR k <= CASE WHEN of_ = 0 THEN 48 WHEN hard THEN 2 * of_ ELSE 6 * of_ END GROUP BY ALL""",
    "negative_share": _T + _PLACED + _EVERY + _KINDS + _placed_draws("share", "q") + """,
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, positive ORDER BY j) AS k, count(*) OVER (PARTITION BY doc_id, positive) AS al FROM drawn)
SELECT doc_id, positive, hard, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts, CAST(sum(te) AS BIGINT) AS sum_te FROM k WHERE positive OR k <= floor(al * 0.05::DOUBLE + 1e-9) GROUP BY ALL""",
    "span_vectors": """WITH d AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, unnest([struct_pack(ts := vec_id % 9, te := vec_id % 9 + vec_id % 8), struct_pack(ts := 0::BIGINT, te := 15::BIGINT)]) AS s FROM embeddings)
SELECT vec_id, s.ts AS ts, s.te AS te, round(list_sum(x[4 * s.ts + 1 : 4 * s.ts + 4]), 6) AS first, round(list_sum(x[4 * s.te + 1 : 4 * s.te + 4]), 6) AS last, round(list_sum(x[4 * s.ts + 1 : 4 * s.te + 4]) / (s.te - s.ts + 1), 6) AS mean, least(s.te - s.ts, 3)::DOUBLE AS width FROM d""",
    "split_train_valid": "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('split:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN rn <= ceil(n * 9 / 10) THEN 'train' ELSE 'valid' END AS part FROM r",
    "softmax_argmax": _LOGITS + " SELECT vec_id, round(list_max(ex) / z, 6) AS confidence, CAST(list_position(x, top) - 1 AS INT) AS predicted FROM p",
    "losses": _LOGITS + ", y AS (SELECT *, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label % 14 END AS y FROM p), v AS (SELECT CASE WHEN y <> -100 THEN -ln(ex[CAST(y + 1 AS INT)] / z) END AS hard, CASE WHEN y <> -100 THEN CASE WHEN y = 0 THEN -0.8 * ln(ex[1] / z) / 0.8 ELSE -0.8 * ln(ex[CAST(y + 1 AS INT)] / z) - 0.2 * ln(ex[1] / z) END END AS soft FROM y) SELECT round(coalesce(avg(hard), 0), 6) AS hard, round(coalesce(avg(soft), 0), 6) AS soft, count(hard) AS n FROM v",
    "usage_cost": _CALLS + " SELECT conv_id, turn, model, round(cost, 9) AS cost_usd FROM d",
    "budget_cutoff": _CALLS + ", m AS (SELECT *, CAST(round(cost * 1e6) AS BIGINT) AS micros FROM d), s AS (SELECT *, sum(micros) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - micros < 5000000 AS ok FROM m) SELECT conv_id, count(*) FILTER (ok) AS n_within, min(turn) FILTER (NOT ok) AS first_beyond, CAST(sum(CASE WHEN ok THEN micros ELSE 0 END) AS BIGINT) AS spent_micros FROM s GROUP BY conv_id",
}
