"""1 and 5: statistics against plain counts, verdicts against a plain fit, held-out accuracy."""

import zlib

import numpy as np

from spanloom.llm import quality_classifier, quality_rules, statistics

from . import brute, plain
from .conftest import EDGES

BIG = "/root/testdata/sf0.01"


def test_statistics(spark, edges):
    out = statistics.add(edges, "text", "s").select("doc_id", "text", "s.*").collect()
    assert len(out) == len(EDGES)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base(r.text), r.doc_id
        w = brute.words(r.text)
        assert (r.n_distinct_words, r.n_same_neighbours) == (len(set(w)), sum(a == b for a, b in zip(w, w[1:], strict=False)))


def test_quality_rules(spark):
    got = quality_rules.op5_quality_rules(spark, BIG).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    assert len(got) == len(docs)
    rows = []
    for r in got:
        want = brute.base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        if not r.base_failed:
            rows.append((r, plain.rules_vector(docs[r.doc_id].text)))
        else:
            assert not r.kept
    distances = plain.distances(np.array([x for _, x in rows]), [docs[r.doc_id].lang for r, _ in rows], [docs[r.doc_id].source for r, _ in rows])
    assert all(r.kept == (d <= quality_rules.CUTOFF) for (r, _), d in zip(rows, distances, strict=True))
    assert np.corrcoef(np.log([r.distance + 1e-3 for r, _ in rows]), np.log(distances + 1e-3))[0, 1] > 0.99
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    judged = [(r.kept, quality[r.doc_id]) for r, _ in rows if r.doc_id in quality]
    assert np.mean([k for k, q in judged if q == 1]) > 0.99 and np.mean([k for k, q in judged if q == 0]) < 0.1


def test_sources_have_estimates_of_their_own(spark):
    """Two sources of one language that differ: texts that are usual in the one are outliers in the other, however few rows a third source has."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9))))
    calm = lambda: " ".join(word() for _ in range(120))
    loud = lambda: " ".join(("!!#" if rng.random() < 0.5 else "") + word().upper() for _ in range(120))
    texts = [("calm", calm()) for _ in range(300)] + [("calm", loud()) for _ in range(3)] + [("loud", loud()) for _ in range(250)] + [("few", calm()) for _ in range(4)] + [("few", loud()), (None, calm())]
    df = spark.createDataFrame([(i, t, "en", source) for i, (source, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.v.kept for r in quality_rules.verdicts(df, "v").collect()}
    by = lambda source, is_loud: [kept[i] for i, (s, t) in enumerate(texts) if s == source and ("#" in t) == is_loud]
    assert all(by("calm", False)) and not any(by("calm", True)) and np.mean(by("loud", True)) > 0.98
    assert all(by("few", False)) and all(by(None, False)) and len(kept) == len(texts)


def test_one_text_in_two_sources(spark):
    """Rows without a doc_id that share a text have their own source's verdict."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9))))
    loud = lambda: " ".join(("!!#" if rng.random() < 0.5 else "") + word().upper() for _ in range(120))
    shared = loud()
    texts = [("calm", " ".join(word() for _ in range(120))) for _ in range(300)] + [("loud", loud()) for _ in range(250)] + [("calm", shared), ("loud", shared)]
    df = spark.createDataFrame([(None, t, "en", source) for source, t in texts], "doc_id long, text string, lang string, source string")
    assert {r.source: r.v.kept for r in quality_rules.verdicts(df, "v").filter(df.text == shared).collect()} == {"calm": False, "loud": True}


def test_a_third_of_a_source_is_junk(spark):
    """Different bad texts, or copies of one, as a third of a source's rows: they don't become its middle."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en'")
    rows = sorted((r.doc_id, r.text, r.quality) for r in docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "quality").collect())
    fine = lambda t: (b := brute.base(t))[0] >= 10 and 100 * b[4] <= 20 * b[0]
    good, bad = ([t for _, t, q in rows if q == k and len(t) < 20000 and fine(t)][:320] for k in (1, 0))
    junk = {"mixed": bad[:160], **{f"copies{k}": [bad[k]] * 160 for k in range(4)}}
    texts = [(source, q, t) for source in junk for q, of in ((1, good), (0, junk[source])) for t in of]
    assert len(texts) == 5 * 480
    df = spark.createDataFrame([(i, t, "en", source) for i, (source, _, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.verdicts(df, "v").filter("v.kept").select("doc_id").collect()}
    share = {(source, q): np.mean([i in kept for i, x in enumerate(texts) if x[:2] == (source, q)]) for source in junk for q in (0, 1)}
    assert all(share[source, 1] > 0.98 for source in junk), share
    assert share["mixed", 0] < 0.1 and all(share[source, 0] == 0 for source in junk if source != "mixed"), share


def test_quality_rules_edges(spark, edges, nothing):
    out = quality_rules.stage(spark, edges, "")
    assert out.columns == edges.columns
    kept = [r.doc_id for r in out.collect()]
    assert {4, 5, 6, 7, 13, 14} <= set(kept) and not {1, 2, 3, 9, 10, 15} & set(kept) and kept.count(7) == 2
    assert quality_rules.verdicts(nothing, "v").count() == 0


def auc(scores, labels):
    a, b = (np.array([s for s, y in zip(scores, labels, strict=True) if y == k]) for k in (1, 0))
    return np.mean([(a > x).mean() + 0.5 * (a == x).mean() for x in b])


def test_quality_classifier(spark):
    got = quality_classifier.op1_quality_classifier(spark, BIG).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, quality[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in quality]
    assert auc([s for s, *_ in held], [y for _, y, _ in held]) > 0.97
    assert np.mean([p == y for _, y, p in held]) > 0.96


def test_quality_classifier_against_a_plain_one(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = {r.doc_id: r.score for r in quality_classifier.op1_quality_classifier(spark, BIG).collect()}
    assert np.allclose([got[i] for i, _ in docs], plain.scores(docs, quality), atol=1e-6)


def test_quality_classifier_edges(spark, edges, nothing):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality")
    none = labels.filter("false")
    assert {r.s for r in quality_classifier.scored(edges, none, "v").select("v.score").toDF("s").collect()} == {0.5}
    ones = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (None, 0), (8, None)], "doc_id long, quality int")
    out = quality_classifier.scored(edges, ones, "v")
    assert out.columns == [*edges.columns, "v"] and out.count() == len(EDGES)
    assert quality_classifier.scored(nothing, ones, "v").count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 19)], "doc_id long, quality int")
    assert all(0 <= r.v.score <= 1 for r in quality_classifier.scored(edges, both, "v").collect())
    assert quality_classifier.stage(spark, edges, "/root/testdata/sf0.001").columns == edges.columns
