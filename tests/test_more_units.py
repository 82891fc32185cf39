"""Operators on small rows: labelling, reports, sources, SQL functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.functions import sql
from spanloom.operators import annotate, costs, detect, evaluate, labelling, score, supervise, tokens
from spanloom.sources import records

from .test_units import lit, one

SUPERVISED = f"doc_id long, n long, types {labelling.PLACED}, senses {labelling.PLACED}, lookalikes {labelling.PLACES}, extra {labelling.PLACES}"


def test_labelled_candidates(spark):
    docs = spark.createDataFrame([(1, 6, [(2, 3, "ORG"), (4, 5, "PERSON")], [(2, 3, "KEEP")], [(4, 5)], [(0, 5)]), (2, 0, [], [], [], []), (3, 2, [], [], [], [(0, 1)])], SUPERVISED)
    rows = {(r.doc_id, r.ts, r.te): r for r in labelling.labelled(docs, "doc_id", most=4).collect()}
    assert len(rows) == 18 + 1 + 3
    assert rows[1, 2, 3].label == "ORG" and rows[1, 2, 3].redact == 0.0 and rows[1, 4, 5].redact == 0.8 and rows[1, 4, 5].sensitivity is None
    # both labels share one token of three with it: the first seen holds
    assert (rows[1, 3, 4].label, rows[1, 3, 4].best_label) == ("NONE", "ORG") and rows[1, 3, 4].weight == pytest.approx(1 / 3)
    assert (rows[1, 0, 0].best_label, rows[1, 0, 0].weight, rows[1, 0, 0].keep) == ("NONE", 1.0, 1.0)
    assert (rows[2, 0, 0].label, rows[2, 0, 0].redact) == ("NONE", 0.0)
    # without negatives: gold and extra places that aren't too long, and a fallback where nothing is left
    none = {(r.doc_id, r.ts, r.te) for r in labelling.labelled(docs, "doc_id", most=4, rate=-1.0).collect()}
    assert none == {(1, 2, 3), (1, 4, 5), (2, 0, 0), (3, 0, 1)}


def test_group_iou_in_the_row(spark):
    gold = F.array(*(F.struct(F.lit(a).cast("bigint").alias("ts"), F.lit(b).cast("bigint").alias("te"), F.lit("ORG").alias("label")) for a, b in ((2, 3), (4, 6))))
    assert one(spark, labelling.best_group(gold, F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).iou == pytest.approx(4 / 6)


def test_budgets(spark):
    docs = spark.createDataFrame([(1, 100, [(10, 11, "ORG")]), (2, 100, [])], f"doc_id long, n long, types {labelling.PLACED}")
    counts = {(r.doc_id, r.positive, r.hard): r["count"] for r in labelling.budgeted(docs, "doc_id").groupBy("doc_id", "positive", "hard").count().collect()}
    assert counts == {(1, True, True): 1, (1, False, True): 2, (1, False, False): 6, (2, False, False): 48}


def test_token_offsets_random(spark):
    import regex

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é́_1-.\t\n\x0b  \U0001f600日٣") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {i: [] for i in range(len(texts))}
    for r in tokens.listed(df, "doc_id", "text").orderBy("doc_id", "tok").collect():
        got[r.doc_id].append((r.s, r.e))
    pattern = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]")
    assert all(got[i] == [m.span() for m in pattern.finditer(t or "")] for i, t in enumerate(texts))


def test_needed_parts_are_in_every_match(spark):
    """What is not searched has no match."""
    from spanloom import vocab

    rng = random.Random(4)
    texts = ["".join(rng.choice("a1.2@ -AB7()x") for _ in range(rng.randrange(5, 60))) for _ in range(3000)] + ["mail a@b.cc", "+49 (30) 1234567", "1.2.3.4", "DE44 1234567890AB", "4111 1111 1111 1111"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, pattern in vocab.PATTERNS.items():
        assert df.filter(F.col("text").rlike(pattern) & ~F.col("text").rlike(vocab.NEEDED[name])).count() == 0
        assert df.filter(F.col("text").rlike(pattern)).count() > 0


def test_decoded_by_label(spark):
    rows = [(1, 0, "ORG", 0, 10, 0.5), (1, 1, "ORG", 2, 9, 0.4), (1, 2, "EMAIL", 0, 10, 0.3), (1, 3, "NONE", 20, 30, 0.9), (1, 4, "PHONE", 40, 50, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, label string, start long, end long, score double")
    assert [(r.label, r.start) for r in score.decoded_by_label(df, "doc_id", {"EMAIL": 0.2}).collect()] == [("ORG", 0)]
    assert sorted(r.label for r in score.decoded_by_label(df, "doc_id", {"PHONE": 0.1}, default=0.45).collect()) == ["ORG", "PHONE"]


def test_thresholds_against_plain(spark):
    rng = random.Random(8)
    scored = [(label, round(rng.random(), rng.choice([1, 2, 6])), rng.random() < 0.4) for label in "AB" for _ in range(400)] + [("A", 1.0, True), ("A", 0.0, False)]
    support = [("A", 190), ("B", 10), ("C", 50)]
    got = {r.label: r for r in supervise.thresholds(spark.createDataFrame(scored, "label string, score double, hit boolean"), spark.createDataFrame(support, "label string, support long")).collect()}
    best = (-1.0, 0.0)
    for cut in sorted({s for k, s, _ in scored if k == "A"}):
        taken = [h for k, s, h in scored if k == "A" and s >= cut]
        tp = sum(taken)
        p, r = tp / (len(taken) + 1e-9), tp / (tp + max(190 - tp, 0) + 1e-9)
        best = max(best, (round(2 * p * r / (p + r + 1e-9), 9), cut))
    assert (got["A"].f1, got["A"].threshold) == pytest.approx(best) and got["B"].default_used and got["C"].default_used


def test_split_against_plain(spark):
    import hashlib

    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(1000)]
    got = {r.doc_id: r.part for r in supervise.split(spark.createDataFrame(rows, "doc_id long, source string"), "source", "doc_id", 9, 10).collect()}
    for source in {s for _, s in rows}:
        ids = sorted((i for i, s in rows if s == source), key=lambda i: (hashlib.md5(f"split:{i}".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == ["train" if 10 * k < 9 * len(ids) else "valid" for k in range(len(ids))]


def test_sides_and_totals(spark):
    rows = [(1, "tp", "ORG", "a", "ORG", "a"), (1, "merged", "ORG", "a b", "ORG", "a"), (1, "used", None, None, "ORG", "b"), (2, "mismatch", " org", "x", None, "x"), (2, "fp", "EMAIL", "y", None, None), (3, "subset", "PHONE", "1", "PHONE", "12")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, pred_label string, pred_value string, gold_label string, gold_value string")
    sides = evaluate.by_side(df)
    got = {(r.kind, r.side, r.label): r.n for r in sides.collect()}
    assert got == {("tp", "pred", "ORG"): 2, ("merged_to_tp", "pred", "ORG"): 1, ("mismatch", "pred", "ORG"): 1, ("mismatch", "gold", "UNKNOWN"): 1, ("fp", "pred", "EMAIL"): 1, ("subset", "pred", "PHONE"): 1, ("subset", "gold", "PHONE"): 1}
    total = evaluate.totals(sides).first()
    assert (total.n_tp, total.n_merged_to_tp, total.n_fn, total.n_mismatch, total.labels) == (2, 1, 0, 1, "EMAIL,ORG,PHONE,UNKNOWN")


def test_rates_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label string, start long, end long")
    row = evaluate.label_accuracy(none, none, ["doc_id", "start", "end"]).first()
    assert (row.n_places, row.accuracy, row.positive_accuracy) == (0, 0.0, 0.0)
    row = evaluate.probability_errors(spark.createDataFrame([(0.9, 1), (0.2, 1), (0.4, None)], "p double, t int"), "p", "t").first()
    assert (row.n, row.accuracy, row.mae) == (2, 0.5, pytest.approx(0.45))
    per = evaluate.per_label(spark.createDataFrame([("ORG", "fn")] * 30, "label string, kind string"))
    row = evaluate.metric_diagnostics(per, none.withColumn("overlaps", F.lit(True))).first()
    assert row.fn_per_tp == float("inf") and row.dead_labels == "ORG" and row.top_labels == "" and row.overlap_share == 0.0


def test_small_forms(spark):
    assert one(spark, C.base_url(F.lit(" http://h:1234// "))) == "http://h:1234/v1" and one(spark, C.base_url(F.lit("http://h/v1/"))) == "http://h/v1" and one(spark, C.base_url(F.lit(" / "))) is None
    assert one(spark, C.with_values_path(F.lit("a.b/c.d.jsonl"))) == "a.b/c.d.with_values.jsonl" and one(spark, C.with_values_path(F.lit("a.b/c"))) == "a.b/c.with_values"
    assert one(spark, C.field_list(F.lit(" spans, ,items,"))) == ["spans", "items"]
    assert one(spark, C.no_quota(F.lit("Error: Insufficient_Quota"))) and not one(spark, C.no_quota(F.lit("quota")))
    assert one(spark, C.call_limit(*lit(10, 4))) == 9 and one(spark, C.is_gguf(F.lit("m.GGUF"))) and one(spark, costs.is_priced(F.lit(" GPT-5 ")))
    assert one(spark, supervise.weighted_sum({"a": F.lit(2.0), "b": F.lit(3.0)}, {"b": 0.5})) == 3.5


def test_items_to_spans(spark):
    schema = "text string, spans array<struct<start:bigint,end:bigint,label:string>>, items array<struct<start:bigint,end:bigint,label:string,category:string,value:string>>"
    items = [(4, 7, "ORG", "PII_LOOKALIKE", None), (0, 3, "PERSON", "REAL_PII", None), (1, 2, None, "REAL_PII", None), (0, 1, "ORG", "PII_LOOKALIKE", "given")]
    df = spark.createDataFrame([("Ann Bob", None, items), ("x", [], items), ("y", None, None)], schema)
    got = df.select(annotate.spans_of(F.col("spans"), F.col("items")).alias("s"), annotate.spans_of_category(F.col("text"), F.col("items"), "PII_LOOKALIKE").alias("c")).collect()
    assert [[tuple(s) for s in r.s] for r in got] == [[(0, 3, "PERSON")], [], []]
    assert [tuple(x) for x in got[0].c] == [(0, 1, "ORG", "given"), (4, 7, "ORG", "Bob")]
    row = df.select(annotate.enriched(F.col("text"), F.col("items")).alias("r")).first().r
    assert (row.updated, row.mismatched, row.spans[3]["value"]) == (4, 1, "A")


def test_sql_functions(spark):
    sql.register(spark)
    assert tuple(spark.sql("SELECT trim_span('  Maria Rossi  ', 0, 15) AS x").first().x) == (2, 13)
    assert spark.sql("SELECT trim_span('    ', 0, 4) AS x").first().x is None
    assert spark.sql("SELECT redact('call Ann or Bob', array(named_struct('start', 12L, 'end', 15L, 'label', 'B'), named_struct('start', 5L, 'end', 8L, 'label', 'A'))) AS x").first().x == "call [REDACTED:A] or [REDACTED:B]"
    assert spark.sql("SELECT redact('abc', array()) AS x").first().x == "abc"


def test_more_files(spark, tmp_path):
    (tmp_path / "nd.json").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    (tmp_path / "list.json").write_text('[{"text": "a"},\n {"text": "b"}]')
    for name in ("nd.json", "list.json"):
        assert sorted(r.text for r in records.read_any(spark, str(tmp_path / name)).collect()) == ["a", "b"]
    (tmp_path / "p1.jsonl").write_text('{"text": "x", "items": [{"start": 0, "end": 1, "label": "ORG", "category": "REAL_PII"}]}\n')
    (tmp_path / "p2.jsonl").write_text('{"text": "y", "spans": []}\n{"spans": [{"start": 0, "end": 1, "label": "ORG"}]}\n')
    rows = records.read_matching(spark, str(tmp_path / "p*.jsonl")).collect()
    assert sorted((r.text, r.converted, len(r.spans)) for r in rows) == [("", False, 1), ("x", True, 1), ("y", False, 0)]
    with pytest.raises(FileNotFoundError):
        records.read_matching(spark, str(tmp_path / "none*.jsonl"))
    assert records.first_existing(spark, [None, str(tmp_path / "gone"), str(tmp_path / "nd.json")]).endswith("nd.json") and records.first_existing(spark, [None]) is None
    (tmp_path / "models.json").write_text(json.dumps([{"name": "a", "base_model": "m"}, {"name": "b", "base_model": "m", "encoder_path": "e"}]))
    assert [r.encoder for r in records.read_specs(spark, str(tmp_path / "models.json")).collect()] == ["m", "e"]
    (tmp_path / "bad.json").write_text('[{"name": "a"}]')
    with pytest.raises(ValueError, match="base_model"):
        records.read_specs(spark, str(tmp_path / "bad.json"))
    records.write_report(spark.range(1).select(F.lit(1).alias("tp"), F.struct(F.lit(0.5).alias("f1")).alias("rates")), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*")
    assert json.loads(part.read_text()) == {"tp": 1, "rates": {"f1": 0.5}} and part.read_text().count("\n") > 2
    records.write_review(spark.createDataFrame([(2, "two"), (1, "one")], "k int, s string"), str(tmp_path / "review"), "k", "s")
    assert "".join(p.read_text() for p in sorted((tmp_path / "review").glob("part-*"))) == "one\n\ntwo\n\n"
    assert [r.id for r in records.shuffled(spark.range(50), "id", 1).collect()] != list(range(50))


def test_commands(spark, tmp_path):
    from spanloom import __main__ as cli

    def lines(path):
        return [json.loads(x) for part in sorted(path.glob("part-*")) for x in part.read_text().splitlines() if x]

    rows = [{"text": "Ann met Bob", "spans": [{"start": 0, "end": 3, "label": "PERSON", "value": "ann"}, {"start": 8, "end": 11, "label": "PERSON"}]}, {"full_text": "x", "items": [{"start": 0, "end": 1, "label": "ORG"}]}]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    cli.main(["enrich", str(tmp_path / "in.jsonl"), "--fields", "spans, items"])
    done = lines(tmp_path / "in.with_values.jsonl")
    assert sorted(s["value"] for r in done for f in ("spans", "items") for s in r.get(f) or []) == ["Ann", "Bob", "x"]
    assert lines(tmp_path / "in.with_values.jsonl.counts") == [{"rows": 2, "updated": 3, "mismatched": 1}]
    with pytest.raises(SystemExit):
        cli.main(["enrich", str(tmp_path / "in.jsonl"), "--fields", " , "])

    side = lambda spans: json.dumps({"doc_id": "1", "spans": [{"start": a, "end": b, "label": k, "value": v} for a, b, k, v in spans]}) + "\n"
    (tmp_path / "p.jsonl").write_text(side([(0, 3, "PERSON", "Ann"), (8, 11, "ORG", "Bob")]))
    (tmp_path / "g.jsonl").write_text(side([(0, 3, "PERSON", "Ann"), (8, 11, "PERSON", "Bob")]))
    cli.main(["errors", str(tmp_path / "p.jsonl"), str(tmp_path / "g.jsonl"), str(tmp_path / "errors")])
    found = {name: (tmp_path / "errors" / name).read_text() for name in ("summary.json", "report.md", "report.html")}
    summary = json.loads(found["summary.json"])
    assert summary["totals"]["n_tp"] == 1 and summary["totals"]["n_mismatch"] == 1 and summary["mismatches"] == [{"predicted": "ORG", "gold": "PERSON", "count": 1}] and summary["labels"] == ["ORG", "PERSON"]
    assert found["report.md"].startswith("# Errors") and "<table>" in found["report.html"]

    good = "[[REAL_PII:person|Ann]] " + " ".join(f"[[NON_PII:n|v{i}]]" for i in range(6)) + " [[PII_LOOKALIKE:org|Acme]] [[REAL_PII:email|a@b.cc]] [[REAL_PII:phone|123]] [[PII_LOOKALIKE:org|Bcme]]"
    responses = [{"call": "a", "content": json.dumps({"examples": [{"annotated_text": good}, {"annotated_text": good}]})}, {"call": "b", "content": json.dumps({"examples": [{"annotated_text": "[[REAL_PII:person|Ann]]"}]})}, {"call": "c", "content": "no json"}]
    (tmp_path / "responses.jsonl").write_text("".join(json.dumps(r) + "\n" for r in responses))
    cli.main(["examples", str(tmp_path / "responses.jsonl"), str(tmp_path / "made")])
    made = lines(tmp_path / "made" / "train") + lines(tmp_path / "made" / "valid")
    assert len(made) == 1 and made[0]["row_id"] == 1 and [s["label"] for s in made[0]["spans"]] == ["PERSON", "EMAIL", "PHONE"] and len(made[0]["pii_lookalike"]) == 2
    rejected = lines(tmp_path / "made" / "rejected")
    assert len(rejected) == 2 and {r["status"] for r in rejected} == {"RETRY", "FAIL"}
