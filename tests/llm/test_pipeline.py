"""The corpus pipeline against its stages done plainly one after another."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from spanloom.llm import quality_classifier, quality_rules, registry, token_output

from . import brute, plain
from .conftest import EDGES, SCHEMA, rows_of


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    good = {r.doc_id for r in quality_classifier.op1_quality_classifier(spark, sf).filter("predicted = 1").collect()}
    rows = [r for r in rows if r[0] in good]
    left = docs.filter(docs.doc_id.isin([i for i, _ in rows]))
    fine = {r.doc_id for r in quality_rules.verdicts(left, "v").filter("v.kept").collect()}
    rows = [r for r in rows if r[0] in fine]
    tops, _ = brute.components(rows)
    rows = [r for k, r in enumerate(rows) if tops[k] == k]
    cut = brute.without_repeats([t for _, t in rows])
    texts = {i: " ".join(kept) if gone else t for (i, t), (_, gone, kept) in zip(rows, cut, strict=True)}
    tool = Tokenizer.from_file(token_output.vocabulary("word_bpe_49k.json"))
    got = Counter()
    whole = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        if r.doc_id not in whole:
            whole[r.doc_id] = np.array([*tool.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        got[r.doc_id] += r.length
    assert got == {i: len(whole[i]) for i in texts} and len(texts) > 100


def test_first_stages_against_plain_ones(spark, sf):
    """The quality stages keep the documents that plain versions in numpy keep."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scores = plain.scores([r[:2] for r in rows], quality)
    good = [r for r, score in zip(rows, scores, strict=True) if score >= quality_classifier.THRESHOLD]
    left = quality_classifier.stage(spark, docs, sf)
    assert sorted(r.doc_id for r in left.collect()) == [r[0] for r in good]
    assert {r.doc_id for r in quality_rules.stage(spark, left, sf).collect()} == plain.kept_by_rules(good)


def test_stages_take_any_rows(spark, sf):
    edges = spark.createDataFrame(rows_of(EDGES), SCHEMA)
    for docs in (edges, edges.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == edges.columns, name
            docs = spark.createDataFrame(docs.collect(), SCHEMA)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{n}" for n in range(1, 14)} | {"pipeline"} and set(registry.oracle_sql()) <= names
