"""The permutation of candidates, and samples by it against all candidates."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import digests, labelling, negatives


@pytest.mark.parametrize(("n", "most"), [(1, 12), (5, 12), (12, 12), (40, 12), (7, 1), (100, 3)])
def test_ranks_and_permutation(n, most):
    begins = negatives.starts(n, most)
    total = int(begins[-1])
    every = [(ts, ts + d) for d in range(most) for ts in range(n - d)]
    assert list(zip(*(x.tolist() for x in negatives.spans_of(np.arange(total), begins)), strict=True)) == every and total == len(every)
    bits = negatives.half_bits(total)
    for key in ("a", "b"):
        k = negatives.key_of(key)
        j = np.arange(4**bits)
        rank = negatives.drawn(j, k, bits)
        assert sorted(rank.tolist()) == j.tolist() and (negatives.place(rank, k, bits) == j).all()


def in_order(n, most, key):
    begins = negatives.starts(n, most)
    total = int(begins[-1])
    bits = negatives.half_bits(total)
    rank = negatives.drawn(np.arange(4**bits), negatives.key_of(key), bits)
    return list(zip(*(x.tolist() for x in negatives.spans_of(rank[rank < total], begins)), strict=True))


def test_budgets_and_shares_against_all_candidates():
    rng = random.Random(1)
    for k in range(150):
        n, most = rng.randrange(0, 60), rng.choice([1, 4, 12])
        places = [(a, min(n - 1, a + rng.randrange(0, 15))) for a in (rng.randrange(n) for _ in range(rng.randrange(4)))] if n else []
        every = in_order(n, most, str(k)) if n else []
        gold = {p for p in places if p[1] - p[0] < most}
        touch = lambda c: any(a <= c[1] and c[0] <= b for a, b in places)  # noqa: B023, E731
        hard, easy = [c for c in every if touch(c) and c not in gold], [c for c in every if not touch(c)]
        of = len(gold)
        got = negatives.budget(n, places, str(k), most, 2, 6, 48)
        assert [r[:2] for r in got if r[2]] == sorted(gold)
        assert [r[:2] for r in got if not r[2] and r[3]] == hard[: 2 * of if of else 48]
        assert [r[:2] for r in got if not r[2] and not r[3]] == easy[: 6 * of if of else 48]
        some = negatives.share(n, places, str(k), most, 0.3)
        rest = [c for c in every if c not in gold]
        assert [(r[:2], r[3]) for r in some if not r[2]] == [(c, touch(c)) for c in rest[: int(0.3 * len(rest) + 1e-9)]]


def test_a_sample_takes_no_longer_for_a_longer_text():
    begun = time.monotonic()
    for n in (10**5, 10**7):
        assert len(negatives.draws(n, 12, "x", 6, lambda a, b: np.ones(len(a), bool))[0]) == 6
    assert time.monotonic() - begun < 1


def test_nulls_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None, None), (2, 0, []), (None, 3, None)], f"doc_id long, n long, types {labelling.PLACED}")
    assert {(r.doc_id, r.ts, r.te) for r in labelling.budgeted(docs, "doc_id").collect()} == {(None, a, b) for a in range(3) for b in range(a, 3)}
    assert labelling.share(docs.filter("false"), "doc_id", 0.5).count() == 0


@pytest.mark.parametrize("names", [["neg:1", "neg:51282", ""], ["neg:" + "\u00e9" * 30, "x" * 200], ["neg:" + "y" * k for k in range(50)]])
def test_digests_of_many_candidates(names):
    rng = random.Random(2)
    ts = [rng.randrange(10 ** rng.randrange(1, 9)) for _ in range(400)]
    heads = [f"{rng.choice(names)}:{t}:".encode() for t in ts]
    got = digests.uniform(heads, np.array(ts), 12)
    assert got.tolist() == [[int(hashlib.md5(h + b"%d" % (t + d)).hexdigest()[:8], 16) / 2**32 for d in range(12)] for h, t in zip(heads, ts, strict=True)]


def test_sampled_candidates_against_all(spark):
    rng = random.Random(3)
    docs = [(str(k), n, [(a, a + rng.randrange(-1, 15), rng.choice("XY")) for a in (rng.randrange(-3, n + 3) for _ in range(rng.randrange(6)))]) for k, n in enumerate([0, 1, 5000, 0, 12, *(rng.randrange(60) for _ in range(40))])]
    docs += [(None, 30, None), ("null", None, [(0, 1, "X")]), ("places", 30, [(None, 2, "X"), (1, None, "X"), (3, 4, None)])]
    docs = spark.createDataFrame(docs, f"doc_id string, n long, types {labelling.PLACED}").coalesce(1)
    every = labelling.enumerated(docs, "doc_id", 12).withColumn("label", labelling.exact_label(F.col("types"), F.col("ts"), F.col("te")))
    at = F.coalesce(F.exists("types", lambda g: (g["ts"] == F.col("ts")) & (g["te"] == F.col("te"))), F.lit(False))
    want = every.filter(at | (C.uniform(F.concat_ws(":", F.lit("neg"), "doc_id", "ts", "te")) <= 0.2)).select("doc_id", "ts", "te", "label")
    got = labelling.sampled(docs, "doc_id", 0.2)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    # what a candidate is given is what all places give it
    all_ = negatives.sampled(docs, "doc_id", 12, None, ["types"], [])
    near = every.withColumn("types", labelling.touching(F.col("types"), F.col("ts"), F.col("te")))
    fits = lambda df: sorted(df.select("doc_id", "ts", "te", F.filter(F.coalesce("types", F.array().cast(labelling.PLACED)), lambda g: g["ts"] <= g["te"]).alias("types")).collect(), key=str)
    assert fits(all_) == fits(near)


def test_candidates_are_made_in_many_tasks(spark):
    """Documents' sizes are small rows, which come together in one task."""
    docs = spark.range(40).selectExpr("id as doc_id", "50L as n", f"cast(array() as {labelling.PLACED}) as types").coalesce(1)
    for rows in (labelling.sampled(docs, "doc_id", 0.2), labelling.budgeted(docs, "doc_id"), labelling.share(docs, "doc_id", 0.5)):
        assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_labels_of_a_long_document_with_many_spans(spark):
    """Candidates meet the spans near them only: with all spans for each candidate this takes minutes."""
    gold = [(30 * k, 30 * k + 2, "XY"[k % 2]) for k in range(4000)]
    docs = spark.createDataFrame([("long", 120_000, gold, [], [], [])], f"doc_id string, n long, types {labelling.PLACED}, senses {labelling.PLACED}, lookalikes {labelling.PLACES}, extra {labelling.PLACES}")
    begun = time.monotonic()
    counts = {r.label: r["count"] for r in labelling.labelled(docs, "doc_id", rate=0.2).groupBy("label").count().collect()}
    assert counts["X"] == counts["Y"] == 2000 and 270_000 < counts["NONE"] < 305_000
    assert time.monotonic() - begun < 45


@pytest.mark.parametrize("work", [lambda n, places, k: negatives._share(n, places, k, 12, 0.5), lambda n, places, k: negatives._budget(n, places, k, 12, 2, 40, 48)])
def test_drawn_candidates_leave_in_bounded_batches(work):
    places = [[{"ts": 9 * k, "te": 9 * k + 1} for k in range(3000)], [], None, [{"ts": 1, "te": 1}]]
    kind = pa.list_(pa.struct([("ts", pa.int64()), ("te", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None]), pa.array(["a", "b", "c", None]), pa.array([60_000, 60_000, None, 9]), pa.array(places, kind)], names=["_key", "_head", "_n", "types"])
    made = list(negatives._made(work, iter([batch])))
    assert len(made) > 1 and all(b.num_rows <= negatives._TOGETHER for b in made)
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    want = [(key, *r) for key, k, n, of in ((1, "a", 60_000, places[0]), (2, "b", 60_000, []), (None, "", 9, places[3])) for r in negatives._rows(work(n, [(p["ts"], p["te"]) for p in of], k))]
    assert got == want
