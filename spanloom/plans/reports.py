"""Reports over whole tables: sides of errors, diagnostics, evaluation of all heads, curation counters, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared, vocab
from ..functions import columns as C
from ..operators import annotate, costs, detect, resolve, supervise
from ..operators import evaluate as E
from ..sources import records
from ..streaming import redaction
from . import curation, scoring, training
from . import fixtures as X
from . import spans as S


def taxonomy_by_side(spark: SparkSession, sf: str) -> DataFrame:
    with X.once(spark, sf):
        return E.by_side(scoring.merged_supersets(spark, sf))


def taxonomy_totals(spark: SparkSession, sf: str) -> DataFrame:
    return E.totals(taxonomy_by_side(spark, sf))


def metric_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    with X.once(spark, sf):
        return E.metric_diagnostics(scoring.per_label_prf(spark, sf), scoring.wrong_place(spark, sf))


def predictions_with_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The three best predictions of each document with how they meet its gold."""
    best = scoring.topk_predictions(spark, sf)
    return E.diagnosed(best, X.gold(spark, sf), "doc_id")


def reachability_report(spark: SparkSession, sf: str) -> DataFrame:
    """Reachable gold spans of all labels together (ALL), and of the five labels with the lowest rates."""
    per = training.reachability(spark, sf)
    whole = per.agg(F.sum("total").alias("total"), F.sum("reachable").alias("reachable")).select(F.lit("ALL").alias("label"), "total", "reachable", F.round(C.safe_div(F.col("reachable").cast("double"), F.col("total").cast("double")), 6).alias("rate"))
    return whole.unionByName(per.orderBy("rate", "label").limit(5))


def multihead_eval(spark: SparkSession, sf: str) -> DataFrame:
    """One row with the scores of every head: tags of tokens, types by value and by overlap, redaction by place, and the probability of REDACT."""
    with X.once(spark, sf):
        return _multihead_eval(spark, sf)


def _multihead_eval(spark: SparkSession, sf: str) -> DataFrame:
    pred, gold = X.pred(spark, sf), X.gold(spark, sf)
    of_tokens = E.tag_accuracy(X.documents(spark, sf), pred, gold, "doc_id", "text")
    related = E.counted(scoring.match_value(spark, sf)).select(*(F.col(c).alias(f"value_{c}") for c in ("tp", "fp", "fn")))
    kinds = scoring.value_relationships(spark, sf).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("mismatch", "subset", "superset")))
    overlap = scoring.soft_prf(spark, sf).select("credit", F.col("f1").alias("overlap_f1"))
    hidden = lambda df: df.filter("label <> 'PHONE'")
    places = E.with_rates(E.counted(E.matched(hidden(pred), hidden(gold), ["doc_id", "start", "end"])))
    places = places.select(*(F.col(c).alias(f"redact_{c}") for c in ("tp", "fp", "fn", "f1")))
    known = gold.select(*scoring.EXACT, (F.col("label") != "PHONE").cast("int").alias("target")).distinct()
    errors = E.probability_errors(pred.join(known, scoring.EXACT), "score", "target").select(F.col("n").alias("n_judged"), F.col("accuracy").alias("redact_accuracy"), "mae", "brier")
    labels = E.label_accuracy(pred, gold, ["doc_id", "start", "end"])
    out = X.documents(spark, sf).agg(F.count(F.lit(1)).alias("n_docs"))
    for part in (of_tokens, related, kinds, overlap, places, errors, labels):
        out = out.crossJoin(part)  # a row each
    return out


def suspicious_gold(spark: SparkSession, sf: str) -> DataFrame:
    """For each label, how many gold spans there are and how many look cut off or are no instance of it."""
    rows = X.gold(spark, sf, with_text=True)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.suspicious(F.col("text"), F.col("start"), F.col("end"), F.col("label"))).alias("n_suspicious"))


def suspicious_rows(spark: SparkSession, sf: str) -> DataFrame:
    """As suspicious_gold(), over the spans and the items of documents together: gold spans stand in either or in both, under various names."""
    span = "struct<start:bigint,end:bigint,start_position:bigint,end_position:bigint,label:string,entity_type:string>"
    key = lambda s: F.concat(F.lit("side:"), F.col("doc_id").cast("string"), F.lit(":"), s["label"], F.lit(":"), s["start"].cast("string"))
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    form = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), none.alias("a"), none.alias("b"), F.lower(s["label"]).alias("label"), text.alias("t")).cast(span)
    other = lambda s: F.struct(none.alias("start"), s["end"].alias("end"), s["start"].alias("a"), s["end"].alias("b"), text.alias("label"), s["label"].alias("t")).cast(span)
    rows = detect.listed(X.documents(spark, sf), ["doc_id", "text"], "text").filter("size(spans) > 0")
    part = lambda low, high, make: F.transform(F.filter("spans", lambda s: (C.uniform(key(s)) >= low) & (C.uniform(key(s)) < high)), make)
    rows = rows.select("text", F.explode(annotate.gold_rows(part(0.0, 0.7, form), part(0.4, 1.0, other))).alias("s")).select("text", "s.*")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(C.suspicious(F.col("text"), F.col("start"), F.col("end"), F.col("label"))).alias("n_suspicious"))


def gold_values(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled values of documents' spans and items together, as sets: some spans have a value of their own, some only offsets, under various names."""
    span = "struct<start:bigint,end:bigint,start_position:bigint,end_position:bigint,label:string,entity_type:string,value:string,entity_value:string>"
    none, word = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), none.alias("a"), none.alias("b"), F.lower(s["label"]).alias("label"), word.alias("t"), F.when(s["start"] % 3 == 0, F.concat(F.lit(" "), s["label"])).alias("value"), word.alias("v")).cast(span)
    two = lambda s: F.struct(s["start"].alias("start"), none.alias("end"), s["start"].alias("a"), (s["end"] + 3).alias("b"), word.alias("label"), s["label"].alias("t"), word.alias("value"), F.when(s["start"] % 2 == 0, F.lit("own")).alias("v")).cast(span)
    rows = detect.listed(X.documents(spark, sf), ["doc_id", "text"], "text").filter("size(spans) > 0")
    rows = rows.select("doc_id", F.explode(annotate.value_rows(F.col("text"), F.transform("spans", one), F.transform("spans", two))).alias("v"))
    return rows.select("doc_id", "v.label", F.md5("v.value").alias("value_md5")).distinct()


def redact_places(spark: SparkSession, sf: str) -> DataFrame:
    """Places to redact from documents' items and companions: some of both stand at one place, some have a value of their own."""
    u = C.uniform(X._key("place"))
    rows = X.gold(spark, sf).withColumn("u", u)
    value = F.when(F.col("u") < 0.5, F.upper("value"))
    items = rows.filter("u < 0.8").select("doc_id", "start", "end", F.when(F.col("u") < 0.2, "PII_LOOKALIKE").otherwise("real_pii").alias("category"), value.alias("value"), F.hash("label").alias("ord"))
    items = items.groupBy("doc_id", "start", "end").agg(F.max_by(F.struct("category", "value"), F.struct("category", "value")).alias("i")).select("doc_id", "start", "end", "i.category", "i.value", F.lit(0).alias("ord"))
    more = rows.filter("u > 0.1").groupBy("doc_id", "start", "end").agg(F.min("u").alias("u")).select("doc_id", "start", "end", F.when(F.col("u") > 0.9, "KEEP").otherwise("REDACT").alias("sensitivity"), F.lit("companion").alias("value"), F.lit(0).alias("ord"))
    found = supervise.redact_places(items, more, X.documents(spark, sf), "doc_id", "text")
    return found.select("doc_id", "start", "end", F.md5("value").alias("value_md5"))


def redact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The redacted preview of every page: found, resolved and replaced within its row."""
    rows = X.table(spark, sf, "pages").select("page_id", "html", redaction.kept(F.col("html")).alias("kept"))
    rows = rows.select("page_id", F.size("kept").cast("bigint").alias("n_spans"), resolve.replaced(F.col("html"), F.col("kept"), redaction.marker).alias("redacted"))
    return rows.select("page_id", "n_spans", F.md5("redacted").alias("redacted_md5"), F.length("redacted").cast("bigint").alias("n_chars"))


def enrich_counts(spark: SparkSession, sf: str) -> DataFrame:
    """For each document with gold its spans with values anew: how many, and how many had another value before; some had none or no offsets."""
    u = C.uniform(X._key("rich"))
    old = F.when(u < 0.3, F.upper("value")).when(u < 0.5, None).otherwise(F.col("value"))
    span = F.struct(F.when(u >= 0.9, None).otherwise(F.col("start")).alias("start"), "end", "label", old.alias("value"))
    rows = X.gold(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = rows.join(X.documents(spark, sf).select("doc_id", "text"), "doc_id").select("doc_id", annotate.enriched(F.col("text"), F.col("spans")).alias("r"))
    return rows.select("doc_id", "r.updated", "r.mismatched", F.md5(F.array_join(F.array_sort(F.transform("r.spans", lambda s: F.coalesce(s["value"], F.lit("-")))), "|")).alias("values_md5"))


def export_counters(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, spans that can be used, and those that can't by reason."""
    bad = curation.malformed_spans(spark, sf)
    reasons = ["row text is not a string", "start/end are not ints", "invalid bounds", "label is not a string", "label is empty"]
    counts = bad.agg(F.countDistinct("doc_id").alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("n_emitted"), F.count("reason").alias("n_malformed"), *(F.count_if(F.col("reason") == r).alias(f"n_reason_{k}") for k, r in enumerate(reasons)))
    return X.documents(spark, sf).agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(counts)  # a row each


def retry_advice(spark: SparkSession, sf: str) -> DataFrame:
    reasons = curation.rejection_counts(spark, sf).filter("status = 'RETRY'").select("reason", "n", F.col("first_doc").alias("seen"))
    return annotate.retry_advice(reasons)


def item_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans that examples' items give, as real ones and as lookalikes."""
    rows = curation._line_items(spark, sf)
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint,label:string>>")
    items = F.transform("items", lambda i: i.withField("value", F.lit(None).cast("string")))
    plain = F.transform("items", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["label"].alias("label"), i["category"].alias("category")))
    real = rows.select("doc_id", F.lit("real").alias("of"), F.explode(annotate.spans_of(none, plain)).alias("s")).select("doc_id", "of", "s.start", "s.end", "s.label", F.lit(None).cast("string").alias("value"))
    like = rows.select("doc_id", F.lit("lookalike").alias("of"), F.posexplode(annotate.spans_of_category(F.col("text"), items, "PII_LOOKALIKE")).alias("k", "s"))
    like = like.select("doc_id", "of", "s.start", "s.end", "s.label", "s.value")
    both = real.unionByName(like)
    return both.select("doc_id", "of", "start", "end", "label", F.md5("value").alias("value_md5"))


def endpoint_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Forms that urls of pages take as endpoints and file names."""
    url = F.col("url")
    model = F.element_at(F.array(*map(F.lit, ("GPT-5 ", "x/Model.GGUF", "gpt-5.4", "unheard-of"))), (F.col("page_id") % 4 + 1).cast("int"))
    message = F.concat(F.when(F.col("page_id") % 3 == 0, "You Exceeded your current quota: ").otherwise("not found: "), url)
    rows = X.table(spark, sf, "pages")
    return rows.select("page_id", C.base_url(F.concat(F.lit(" "), url, F.lit("// "))).alias("base_url"), C.with_values_path(url).alias("with_values"), C.is_gguf(model).alias("is_gguf"), costs.is_priced(model).alias("is_priced"), C.no_quota(message).alias("no_quota"), C.call_limit(F.col("page_id"), F.lit(7)).alias("call_limit"), F.size(C.field_list(F.translate(url, "/.", ",,"))).cast("bigint").alias("n_fields"))


def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """Examples written as lines to several files, half with items for spans, and read back by a pattern: spans and whether they were converted."""
    folder = shared.new_path(spark, "json")
    span = F.struct("start", "end", "label", F.lit("REAL_PII").alias("category"))
    rows = X.gold(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("s"))
    form = F.col("doc_id") % 2 == 0
    rows = rows.select(F.col("doc_id").cast("string").alias("text"), F.when(form, F.col("s")).alias("items"), F.when(~form, F.col("s")).alias("spans"))
    records.write_lines(rows.repartition(4), folder, "overwrite")
    back = records.read_matching(spark, f"{folder}/part-*.json")
    return back.select(F.col("text").cast("bigint").alias("doc_id"), "converted", F.explode("spans").alias("s")).select("doc_id", "converted", "s.start", "s.end", "s.label")


QUERIES = {f.__name__: f for f in (taxonomy_by_side, taxonomy_totals, metric_diagnostics, predictions_with_verdicts, reachability_report, multihead_eval, suspicious_gold, suspicious_rows, gold_values, redact_places, redact_pages, enrich_counts, export_counters, retry_advice, item_spans, endpoint_forms, json_files)}

_U = X.UNIFORM.format
_BOTH = scoring._BOTH
_SAFE = "CASE WHEN {0} IS NULL OR " + scoring._STRIP.format("{0}").replace("{85}", "{{85}}").replace("{Z}", "{{Z}}") + " = '' THEN 'UNKNOWN' ELSE upper(" + scoring._STRIP.format("{0}").replace("{85}", "{{85}}").replace("{Z}", "{{Z}}") + ") END"
_SIDES = _BOTH + scoring._RELATED + scoring._MERGED + f""",
sided AS (SELECT CASE WHEN kind = 'merged' THEN 'tp' ELSE kind END AS kind, 'pred' AS side, {_SAFE.format('pred_label')} AS label FROM merged WHERE kind IN ('tp', 'merged', 'fp', 'subset', 'superset', 'mismatch')
  UNION ALL SELECT 'merged_to_tp', 'pred', {_SAFE.format('pred_label')} FROM merged WHERE kind = 'merged'
  UNION ALL SELECT kind, 'gold', {_SAFE.format('gold_label')} FROM merged WHERE kind IN ('fn', 'subset', 'superset', 'mismatch')),
bysides AS (SELECT kind, side, label, count(*) AS n FROM sided GROUP BY ALL)"""
_TOTAL = lambda k, side: f"CAST(coalesce(sum(n) FILTER (kind = '{k}' AND side = '{side}'), 0) AS BIGINT) AS n_{k}"
_WRONG = """, w AS (SELECT DISTINCT doc_id, label, start, "end" FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.label = p.label AND g.start = p.start AND g."end" = p."end")),
wrong AS (SELECT w.doc_id, w.label, w.start, w."end", bool_or(greatest(w.start, g.start) < least(w."end", g."end")) AS "overlaps" FROM w JOIN gold g USING (doc_id, label) GROUP BY w.doc_id, w.label, w.start, w."end")"""
_VERDICT = """['NO_OVERLAP', 'OVERLAP_DIFF_LABEL', 'OVERLAP_SAME_LABEL', 'EXACT'][CAST(max(CASE WHEN g.label IS NULL THEN 1 WHEN g.start = p.start AND g."end" = p."end" AND g.label = p.label THEN 4 WHEN g.label = p.label THEN 3 ELSE 2 END) AS INT)] AS verdict"""
_TAGS = """, {0}h AS (SELECT t.doc_id, tok, g.start, g."end", CASE WHEN tok = min(tok) OVER (PARTITION BY t.doc_id, g.start, g."end") THEN 'B' ELSE 'I' END AS tag FROM toks t JOIN (SELECT DISTINCT doc_id, start, "end" FROM {0}) g ON g.doc_id = t.doc_id AND greatest(s, g.start) < least(e, g."end")),
{0}tags AS (SELECT doc_id, tok, arg_max(tag, (start, "end")) AS tag FROM {0}h GROUP BY doc_id, tok)""".format
_EVAL = (
    "WITH" + X.GOLD + "," + X.TOKEN_PARTS + X.PRED + _TAGS("gold") + _TAGS("pred")
    + """, tagged AS (SELECT coalesce(a.tag, 'O') = coalesce(b.tag, 'O') AS same FROM toks t LEFT JOIN goldtags a ON a.doc_id = t.doc_id AND a.tok = t.tok LEFT JOIN predtags b ON b.doc_id = t.doc_id AND b.tok = t.tok),
e1 AS (SELECT count(*) AS n_tokens, round(coalesce(avg(same::INT::DOUBLE), 0), 6) AS tag_accuracy FROM tagged)"""
    + scoring._RELATED
    + """, e2 AS (SELECT count(*) FILTER (kind = 'tp') AS value_tp, count(*) FILTER (kind = 'fp') AS value_fp, count(*) FILTER (kind = 'fn') AS value_fn FROM m),
e3 AS (SELECT count(*) FILTER (kind = 'mismatch') AS n_mismatch, count(*) FILTER (kind = 'subset') AS n_subset, count(*) FILTER (kind = 'superset') AS n_superset FROM related)"""
    + scoring._PAIRS
    + scoring._CREDIT
    + """, cs AS (SELECT (SELECT coalesce(sum(credit), 0.0::DOUBLE) FROM credited) AS c, (SELECT count(*) FROM pred) AS np_, (SELECT count(*) FROM gold) AS ng_),
e4 AS (SELECT round(c, 6) AS credit, round(CASE WHEN np_ + ng_ = 0 THEN 0 ELSE 2 * c / (np_ + ng_) END, 6) AS overlap_f1 FROM cs),
rp AS (SELECT DISTINCT doc_id, start, "end", true AS x FROM pred WHERE label <> 'PHONE'), rg AS (SELECT DISTINCT doc_id, start, "end", true AS x FROM gold WHERE label <> 'PHONE'),
rm AS (SELECT count(*) FILTER (rp.x AND rg.x) AS redact_tp, count(*) FILTER (rp.x AND rg.x IS NULL) AS redact_fp, count(*) FILTER (rp.x IS NULL) AS redact_fn FROM rp FULL JOIN rg USING (doc_id, start, "end")),
e5 AS (SELECT *, round(CASE WHEN redact_tp = 0 THEN 0.0::DOUBLE ELSE 2 * redact_tp / (2 * redact_tp + redact_fp + redact_fn) END, 6) AS redact_f1 FROM rm),
kn AS (SELECT DISTINCT doc_id, label, start, "end", (label <> 'PHONE')::INT AS target FROM gold), pj AS (SELECT p.score, kn.target FROM pred p JOIN kn USING (doc_id, label, start, "end")),
e6 AS (SELECT count(*) AS n_judged, round(avg(((score >= 0.5)::INT = target)::INT), 6) AS redact_accuracy, round(avg(abs(score - target)), 6) AS mae, round(avg((score - target) * (score - target)), 6) AS brier FROM pj),
lp AS (SELECT doc_id, start, "end", min(label) AS p FROM pred GROUP BY ALL), lg AS (SELECT doc_id, start, "end", min(label) AS g FROM gold GROUP BY ALL),
lb AS (SELECT coalesce(p, 'NONE') AS p, coalesce(g, 'NONE') AS g FROM lp FULL JOIN lg USING (doc_id, start, "end")),
e7 AS (SELECT count(*) AS n_places, round(avg((p = g)::INT), 6) AS accuracy, round(coalesce(avg((p = g)::INT) FILTER (g <> 'NONE'), 0), 6) AS positive_accuracy FROM lb)
SELECT (SELECT count(*) FROM documents) AS n_docs, * FROM e1, e2, e3, e4, e5, e6, e7"""
)
_CARD = "length(regexp_replace(value, '[^0-9]', '', 'g'))"
_SUSPICIOUS = f""", s AS (SELECT g.*, {scoring._STRIP.format('g.value')} AS bare, CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END AS b, substr(text, "end" + 1, 1) AS a FROM GOLD_ROWS g JOIN documents USING (doc_id)),
j AS (SELECT label, coalesce(CASE WHEN bare = '' THEN true WHEN label = 'EMAIL' THEN NOT regexp_matches(bare, '{vocab.WHOLE_EMAIL}') WHEN label = 'IP_ADDRESS' THEN NOT regexp_matches(bare, '{vocab.WHOLE_IP}') WHEN label = 'CREDIT_CARD' THEN {_CARD} < 13 OR regexp_matches(b, '^[0-9]$') OR regexp_matches(a, '^[0-9]$') WHEN label = 'ADDRESS' THEN regexp_matches(value, '[0-9]$') AND regexp_matches(a, '^[0-9]$') END, false) AS bad FROM s)
SELECT label, count(*) AS n, count(*) FILTER (bad) AS n_suspicious FROM j GROUP BY label"""
ORACLES = {
    "taxonomy_by_side": _SIDES + " SELECT * FROM bysides",
    "taxonomy_totals": _SIDES + " SELECT " + ", ".join(_TOTAL(k, s) for k, s in (("tp", "pred"), ("merged_to_tp", "pred"), ("fp", "pred"), ("fn", "gold"), ("subset", "gold"), ("superset", "gold"), ("mismatch", "gold"))) + ", array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM bysides",
    "metric_diagnostics": _BOTH + scoring._EXACT + scoring._LABELS + scoring._PER + _WRONG + """, t AS (SELECT CASE WHEN sum(tp) > 0 THEN round(sum(fp) / sum(tp), 6) ELSE 'inf'::DOUBLE END AS fp_per_tp, CASE WHEN sum(tp) > 0 THEN round(sum(fn) / sum(tp), 6) ELSE 'inf'::DOUBLE END AS fn_per_tp,
  array_to_string(list(label || ':' || predicted ORDER BY predicted DESC, label) FILTER (predicted > 0)[1:5], ',') AS top_labels, coalesce(array_to_string(list(label ORDER BY label) FILTER (support >= 20 AND tp = 0), ','), '') AS dead_labels FROM rated),
o AS (SELECT count(*) AS wrong_place, count(*) FILTER ("overlaps") AS wrong_place_overlap FROM wrong) SELECT *, round(CASE WHEN wrong_place = 0 THEN 0.0::DOUBLE ELSE wrong_place_overlap / wrong_place END, 6) AS overlap_share FROM t, o""",
    "predictions_with_verdicts": _BOTH + ', p AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, "end", label) AS rank, label, start, "end", score FROM pred) WHERE rank <= 3) SELECT p.doc_id, p.rank, p.label, p.start, p."end", p.score, ' + _VERDICT + ' FROM p LEFT JOIN gold g ON g.doc_id = p.doc_id AND greatest(g.start, p.start) < least(g."end", p."end") GROUP BY p.doc_id, p.rank, p.label, p.start, p."end", p.score',
    "reachability_report": S._TOKS_OF_GOLD + training._PLACED + ", c AS (SELECT label, count(*) AS total, count(*) FILTER (te - ts < 12) AS reachable FROM placed GROUP BY label), r AS (SELECT *, round(reachable / total, 6) AS rate FROM c) SELECT 'ALL' AS label, CAST(sum(total) AS BIGINT) AS total, CAST(sum(reachable) AS BIGINT) AS reachable, round(sum(reachable) / sum(total), 6) AS rate FROM c UNION ALL (SELECT * FROM r ORDER BY rate, label LIMIT 5)",
    "multihead_eval": _EVAL,
    "suspicious_gold": "WITH" + X.GOLD + _SUSPICIOUS.replace("GOLD_ROWS", "gold"),
    "suspicious_rows": "WITH" + X.GOLD + f""", su AS (SELECT *, {_U("'side:' || doc_id || ':' || label || ':' || start")} AS u FROM gold), sides AS (SELECT * FROM su WHERE u < 0.7 UNION ALL SELECT * FROM su WHERE u >= 0.4)""" + _SUSPICIOUS.replace("GOLD_ROWS", "sides"),
    "gold_values": "WITH" + X.GOLD + f""", gv AS (SELECT doc_id, label, CASE WHEN start % 3 = 0 THEN label ELSE value END AS v FROM gold
  UNION ALL SELECT g.doc_id, g.label, CASE WHEN g.start % 2 = 0 THEN 'own' ELSE substr(d.text, g.start + 1, g."end" + 3 - g.start) END FROM gold g JOIN documents d USING (doc_id))
SELECT DISTINCT doc_id, label, md5({scoring._STRIP.format('v')}) AS value_md5 FROM gv""",
    "redact_places": "WITH" + X.GOLD + f""", pu AS (SELECT *, {_U("'place:' || doc_id || ':' || label || ':' || start")} AS u FROM gold),
pi AS (SELECT doc_id, start, "end", max((CASE WHEN u < 0.2 THEN 'PII_LOOKALIKE' ELSE 'real_pii' END, coalesce(CASE WHEN u < 0.5 THEN upper(value) END, ''))) AS i, any_value(value) AS own FROM pu WHERE u < 0.8 GROUP BY ALL),
pc AS (SELECT doc_id, start, "end", min(u) AS u FROM pu WHERE u > 0.1 GROUP BY ALL)
SELECT doc_id, start, "end", md5(CASE WHEN i[1] = 'real_pii' THEN coalesce(nullif(i[2], ''), own) ELSE 'companion' END) AS value_md5 FROM pi FULL JOIN pc USING (doc_id, start, "end") WHERE i[1] = 'real_pii' OR pc.u <= 0.9""",
    "redact_pages": "WITH pages_ AS (SELECT page_id AS doc_id, html AS text, '' AS lang FROM pages)," + S.ORACLES["redact_text"][4:].replace("FROM documents", "FROM pages_").replace("SELECT doc_id, lang, n_spans, md5(r)", "SELECT doc_id AS page_id, n_spans, md5(r)"),
    "enrich_counts": "WITH" + X.GOLD + f""", u AS (SELECT *, {_U("'rich:' || doc_id || ':' || label || ':' || start")} AS u FROM gold),
o AS (SELECT doc_id, u < 0.9 AS has, value, CASE WHEN u < 0.3 THEN upper(value) WHEN u < 0.5 THEN NULL ELSE value END AS old FROM u)
SELECT doc_id, count(*) FILTER (has) AS updated, count(*) FILTER (has AND old <> value) AS mismatched, md5(array_to_string(list_sort(list(CASE WHEN has THEN value ELSE coalesce(old, '-') END)), '|')) AS values_md5 FROM o GROUP BY doc_id""",
    "export_counters": curation.ORACLES["malformed_spans"].replace("SELECT doc_id, start AS ord", ", e AS (SELECT doc_id, start AS ord", 1)
    + ") SELECT (SELECT count(*) FROM documents) AS n_docs, count(DISTINCT doc_id) AS n_rows, count(*) FILTER (reason IS NULL) AS n_emitted, count(reason) AS n_malformed, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS n_reason_{k}" for k, r in enumerate(("row text is not a string", "start/end are not ints", "invalid bounds", "label is not a string", "label is empty"))) + " FROM e",
    "retry_advice": curation._ITEMS + ", s AS (SELECT reason, count(*) AS n, min(doc_id) AS seen FROM r WHERE status = 'RETRY' GROUP BY reason), t AS (SELECT * FROM s ORDER BY n DESC, seen LIMIT 3) SELECT string_agg(reason || ' (x' || n || ')', '; ' ORDER BY n DESC, seen) AS advice FROM t",
    "item_spans": curation._ITEMS + """ SELECT doc_id, 'real' AS of, start, "end", lab AS label, NULL::VARCHAR AS value_md5 FROM c WHERE cat = 'REAL_PII' UNION ALL SELECT doc_id, 'lookalike', start, "end", lab, md5(line) FROM c WHERE cat = 'PII_LOOKALIKE'""",
    "endpoint_forms": """
WITH p AS (SELECT page_id, url, ['GPT-5 ', 'x/Model.GGUF', 'gpt-5.4', 'unheard-of'][CAST(page_id % 4 + 1 AS INT)] AS model, regexp_replace(url, '/+$', '') AS bare FROM pages)
SELECT page_id, CASE WHEN bare = '' THEN NULL WHEN ends_with(bare, '/v1') THEN bare ELSE bare || '/v1' END AS base_url, CASE WHEN regexp_matches(url, '[^/.]\\.[^./]*$') THEN regexp_replace(url, '([^/.])(\\.[^./]*)$', '\\1.with_values\\2') ELSE url || '.with_values' END AS with_values,
  page_id % 4 = 1 AS is_gguf, page_id % 4 IN (0, 2) AS is_priced, page_id % 3 = 0 AS no_quota, CAST(ceil(page_id / 7) * 3 AS BIGINT) AS call_limit, len(list_filter(string_split(translate(url, '/.', ',,'), ','), lambda x: trim(x) <> '')) AS n_fields FROM p""",
    "json_files": "WITH" + X.GOLD + ' SELECT doc_id, doc_id % 2 = 0 AS converted, start, "end", label FROM gold',
}
