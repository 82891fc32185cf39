"""11 against brute force: exact distances, recall with several levels of parts, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import learned_partitions as parts

SCHEMA = "vec_id long, embedding array<float>, k1 string, node string, ids string"


def exact(rows, is_query, k=10):
    """query_id to (score, vec_id) of its k nearest, over rows that take part."""
    rows = sorted({(i, tuple(v)) for i, v in rows}, key=lambda r: r[0])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    found = {}
    for i, v in rows:
        if is_query(i):
            far = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            found[i] = [(far[j], int(ids[j])) for j in order]
    return found


def got(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    return found


def recall(found, want):
    return sum(len({i for _, i in found.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / sum(len(w) for w in want.values())


@pytest.mark.parametrize(("rows_a_part", "fan"), [(parts.ROWS, parts.FAN), (100, 4)])
def test_recall(spark, rows_a_part, fan):
    """2,000 vectors: whole, then parts on three levels."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    found, want = got(parts.neighbours(table, F.col("vec_id") % 50 == 0, rows_a_part=rows_a_part, fan=fan)), exact(rows, lambda i: i % 50 == 0)
    assert recall(found, want) >= (1 if rows_a_part == parts.ROWS and len(rows) < 2 * parts.ROWS else 0.9)
    sure = {(q, i): s for q, w in exact(rows, lambda i: i % 50 == 0, k=len(rows)).items() for s, i in w}
    assert all(s == pytest.approx(sure[q, i], rel=1e-12) for q, w in found.items() for s, i in w)
    assert all(len(w) == 10 and w == sorted(w) for w in found.values())


def test_odd_rows(spark):
    """Nulls, zero and broken vectors, another length, copies of a vector and of a row, ties, and few rows."""
    nan, inf = math.nan, math.inf
    good = [(0, [1, 0]), (0, [1, 0]), (1, [0, 1]), (2, [0, -1]), (100, [1, 0]), (3, [-1, 0]), (200, [1e-30, 0]), (4, [1, 0]), (300, [1, 0]), (-100, [3, 4]), (5, [1, 0]), *((k, [1, 0]) for k in range(11, 40))]
    bad = [(None, [1, 0]), (400, None), (6, [0, 0]), (7, [-0.0, 0]), (8, [nan, 1]), (9, [inf, 1]), (500, [1, None]), (600, []), (700, [1, 2, 3])]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", "y", "z") for i, v in good + bad]
    found = got(parts.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0))
    want = exact([(i, [float(np.float32(c)) for c in v]) for i, v in good], lambda i: i % 100 == 0)
    assert found == {q: [(pytest.approx(s), i) for s, i in w] for q, w in want.items()}
    assert got(parts.neighbours(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 100 == 0)) == {}
    assert got(parts.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)) == {}


def test_a_third_of_the_rows_share_a_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 6)).round(3)
    x[::3] = x[0]
    rows = [(k, v.tolist(), "x", "y", "z") for k, v in enumerate(x)]
    found = got(parts.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, rows_a_part=100, fan=3))
    want = exact([(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows], lambda i: i % 10 == 0)
    assert recall(found, want) >= 0.9
    assert all([i for _, i in found[q]] == [i for _, i in want[q]] for q in want if q % 3 == 0)


def test_balanced_parts_cut_few_edges():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 16)) * 3
    x = np.concatenate([c + rng.standard_normal((125, 16)) for c in centres])
    near = parts.nearest(x, x, 10, same=True)
    part = parts.balanced(near, 8, rng)
    assert np.bincount(part).tolist() == [125] * 8
    assert (part[near] != part[:, None]).mean() < 0.02
    part = parts.balanced(near, 7, rng)
    assert len(np.unique(part)) == 7 and np.ptp(np.bincount(part)) <= 3


def test_classifier_learns_the_parts():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.standard_normal((300, 8)) for c in rng.standard_normal((6, 8)) * 4])
    model = parts.fitted(rng.permutation(x), 6)
    best = parts.ranked(model, x)[:, 0].reshape(6, 300)
    assert all(np.bincount(b, minlength=6).max() > 270 for b in best) and model["probes"] <= 2
