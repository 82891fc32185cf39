"""11. Approximate nearest neighbours: a balanced partition of a neighbour graph, learned by a small classifier.

1. A node (the table at first) that holds more than twice ROWS vectors is divided. A bounded sample of it gives a
   graph of nearest neighbours, which is cut into parts of equal size: bisections by the graph's slowest mode,
   mended by swaps that cut fewer edges. A softmax classifier learns from a vector which parts its neighbours are in.
2. The classifier deals every vector of the node to its most probable part, and on vectors held out from the sample
   it is measured how many of the most probable parts hold TARGET of their neighbours: so many a query goes to.
3. Parts that are still too large are divided in the same way, level by level, so that a part's size doesn't grow
   with the table.
4. Queries and vectors that meet in a part are compared there, block against block, and the best are kept.

Sampling, fitting, dealing and comparing all happen in tasks over bounded groups; nothing but counts and the length
of vectors reaches the driver. Equal vectors are one class, searched and found once, whatever number of rows it has.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that a part should hold, and the most parts that a node is divided into.
ROWS, FAN = 1024, 32
#: Vectors of a node that its partition is fitted on at most, and those held out to choose how many parts are probed.
SAMPLE, HELD = 4096, 512
#: Neighbours of a vector in the graph.
DEGREE = 10
#: The share of the held-out vectors' neighbours that the probed parts must hold, at each level.
TARGET = 0.98
#: Levels of parts; what is still large after so many is compared in blocks, as any part is.
LEVELS = 6
#: Vectors and queries in a block.
BLOCK, ASKED = 4096, 1024

_CLASS = "k1 long, k2 long, vector array<double>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def nearest(asked: np.ndarray, among: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """The indices of the k nearest of ``among``, without the row itself where both are the same."""
    found = np.empty((len(asked), k), np.int64)
    for a in range(0, len(asked), 512):
        far = _squares(asked[a : a + 512], among)
        if same:
            far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        found[a : a + 512] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return found


def _bisected(n: int, u: np.ndarray, v: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Which ``left`` of n nodes to put on one side, so that few of the edges (u, v), both ways in the list, are cut."""
    degree = np.bincount(u, minlength=n) + 1e-9
    x = rng.standard_normal(n)
    for _ in range(40):
        x -= (x * degree).sum() / degree.sum()
        x = x / (np.abs(x).max() + 1e-300) + np.bincount(u, x[v], n) / degree
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[:left]] = True
    cut = (side[u] != side[v]).sum()
    for _ in range(12):
        gain = np.bincount(u, np.where(side[u] != side[v], 1.0, -1.0), n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        most = max(1, min(len(a), len(b)) // 10)
        pays = np.flatnonzero(gain[a[:most]] + gain[b[:most]] > 0)
        tried = side.copy()
        tried[a[pays]], tried[b[pays]] = False, True
        now = (tried[u] != tried[v]).sum()
        if now >= cut:
            break
        side, cut = tried, now
    return side


def balanced(neighbours: np.ndarray, m: int, rng: np.random.Generator) -> np.ndarray:
    """A part from 0 to m - 1 for each node of the graph; parts differ in size by a few nodes at most."""
    n, k = neighbours.shape
    u, v = np.repeat(np.arange(n), k), neighbours.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    part = np.zeros(n, np.int64)
    todo = [(0, m)]
    while todo:
        first, count = todo.pop()
        if count == 1:
            continue
        here = np.flatnonzero(part == first)
        place = np.full(n, -1)
        place[here] = np.arange(len(here))
        inside = (place[u] >= 0) & (place[v] >= 0)
        side = _bisected(len(here), place[u[inside]], place[v[inside]], len(here) * (count // 2) // count, rng)
        part[here[~side]] = first + count // 2
        todo += [(first, count // 2), (first + count // 2, count - count // 2)]
    return part


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learned(x: np.ndarray, goals: np.ndarray, rng: np.random.Generator, epochs: int = 60) -> np.ndarray:
    """Weights of a softmax classifier, a bias last, whose probabilities come near the goals (a row for each of x); Adam on small batches."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, s, step = np.zeros((x.shape[1], goals.shape[1])), 0.0, 0.0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = x[order[a : a + 256]]
            slope = rows.T @ (_softmax(rows @ w) - goals[order[a : a + 256]]) / len(rows) + 1e-4 * w
            step += 1
            m, s = 0.9 * m + 0.1 * slope, 0.99 * s + 0.01 * slope * slope
            w = w - 0.05 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w


def fitted(x: np.ndarray, m: int, target: float = TARGET) -> dict:
    """A node's model from its sample: the classifier over scaled vectors and the number of parts to probe."""
    rng = np.random.default_rng(len(x) * 1009 + m)
    middle, spread = x.mean(0), x.std() or 1.0
    x = (x - middle) / spread
    held = min(HELD, len(x) // 8)
    fresh, x = x[:held], x[held : held + SAMPLE]
    k = min(DEGREE, len(x) - 1)
    near = nearest(x, x, k, same=True)
    part = balanced(near, m, rng)
    goals = np.zeros((len(x), m))
    np.add.at(goals, (np.repeat(np.arange(len(x)), k), part[near].ravel()), 1 / (k + 1))
    goals[np.arange(len(x)), part] += 1 / (k + 1)
    w = learned(x, goals, rng)
    model = {"middle": middle, "spread": spread, "weights": w, "probes": m}
    dealt = ranked(model, x * spread + middle)[:, 0]
    order = ranked(model, fresh * spread + middle)
    place = np.empty_like(order)
    place[np.arange(held)[:, None], order] = np.arange(m)
    at = place[np.arange(held)[:, None], dealt[nearest(fresh, x, k)]]
    covered = np.cumsum(np.bincount(at.ravel(), minlength=m)) / max(1, at.size)
    model["probes"] = int(min(m, np.searchsorted(covered, target) + 1))
    return model


def ranked(model: dict, x: np.ndarray) -> np.ndarray:
    """For each vector, the parts from the most to the least probable."""
    scores = np.hstack([(x - model["middle"]) / model["spread"], np.ones((len(x), 1))]) @ model["weights"]
    return np.argsort(-scores, axis=1, kind="stable")


def _fit(rows_a_part: int, fan: int, target: float):
    def fit(group: pa.Table) -> pa.Table:
        # in an order of its own, so that a run again gives the same
        group = group.sort_by([("k1", "ascending"), ("k2", "ascending")]).slice(0, SAMPLE + HELD)
        n = group.column("n")[0].as_py()
        model = fitted(_matrix(group.column("vector")), min(fan, -(-n // rows_a_part), group.num_rows // 8), target)
        return pa.table({"node": group.column("node").slice(0, 1), "model": pa.array([pickle.dumps(model)], pa.binary())})

    return fit


def _deal(probe: bool):
    def deal(rows: pa.Table, models: pa.Table) -> pa.Table:
        keep = rows.select(["k1", "k2", "vector", "node"])
        if not models.num_rows or not rows.num_rows:
            return keep
        model = pickle.loads(models.column("model")[0].as_py())  # noqa: S301 - written by _fit in this job
        take = model["probes"] if probe else 1
        best = ranked(model, _matrix(rows.column("vector")))[:, :take]
        node = rows.column("node")[0].as_py() * 64 + 1 + best
        keep = keep.take(pa.array(np.repeat(np.arange(rows.num_rows), take)))
        return keep.set_column(3, "node", pa.array(node.ravel()))

    return deal


def _dealt(rows: DataFrame, models: DataFrame, probe: bool) -> DataFrame:
    """rows (k1, k2, vector, node) in the parts of their nodes; nodes without a model stay. Groups of about BLOCK rows meet a copy of the model."""
    counts = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("long").alias("blocks"))
    blocked = rows.join(counts, "node").withColumn("block", F.pmod(F.xxhash64("k2", "k1"), "blocks"))
    copies = models.join(counts, "node").select("node", "model", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return blocked.groupBy("node", "block").cogroup(copies.groupBy("node", "block")).applyInArrow(_deal(probe), f"{_CLASS}, node long")


def _compare(k: int):
    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The k nearest classes of each asked one, by exact distances: products of matrices only say which can't be among them."""
        if not rows.num_rows or not asked.num_rows:
            rows, asked = rows.slice(0, 0), asked.slice(0, 0)
        c, q = _matrix(rows.column("vector")), _matrix(asked.column("vector"))
        least = np.array([i[0] for i in rows.column("ids").to_pylist()], np.int64)
        who, what, far = [], [], []
        for a in range(len(q)):
            rough = _squares(q[a : a + 1], c)[0]
            slack = 1e-9 * ((q[a] ** 2).sum() + (c * c).sum(1).max())
            bound = np.partition(rough, min(k, len(rough)) - 1)[min(k, len(rough)) - 1]
            some = np.flatnonzero(rough <= bound + slack)
            exact = np.sqrt(((c[some] - q[a]) ** 2).sum(1))
            best = np.lexsort((least[some], exact))[:k]
            who.append(np.full(len(best), a))
            what.append(some[best])
            far.append(exact[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        who, what = pa.array(join(who, np.int64)), pa.array(join(what, np.int64))
        return pa.table({"k1": asked.column("k1").take(who), "k2": asked.column("k2").take(who), "score": pa.array(join(far, np.float64)), "ids": rows.column("ids").take(what)})

    return compare


def _whole(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, with k1 and k2, 128 bits of the vector."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(F.coalesce(sound, F.lit(False)))
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    rows = rows.filter(F.size("vector") == (length.n if length else 0))
    return rows.select("vec_id", "vector", *(F.xxhash64(F.lit(s), "vector").alias(f"k{s}") for s in (1, 2)))


def neighbours(vectors: DataFrame, queries, k: int = 10, rows_a_part: int = ROWS, fan: int = FAN, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance, in doubles) of the k nearest found of each row of vectors (vec_id, embedding) for which ``queries`` holds (a condition on vec_id), nearest first, ties to the smaller vec_id.

    Every row but the query's own is a candidate. Rows without a vec_id, and vectors that are null, empty, zero or hold
    a null or something that isn't finite, take no part, nor do vectors of another length than the commonest (of two
    equally common, the shorter). Rows that repeat count once, rows that share a vec_id are left out for each other's
    queries. Other columns are left aside; no vectors give no rows. Components are at most 1e150, or distances overflow.
    The result reads from tables in the shared folder.
    """
    if fan > 63:
        raise ValueError("a node has at most 63 parts")
    spark = vectors.sparkSession
    with common.scratch(spark) as scratch:
        rows = scratch.table(_whole(vectors).groupBy("k1", "k2", "vec_id").agg(F.first("vector").alias("vector")), "vectors")
        first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
        least = rows.withColumn("rn", first).filter(F.col("rn") <= k + 1).groupBy("k1", "k2")
        classes = scratch.table(least.agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.lit(0).cast("long").alias("node")), "classes")
        asking = rows.filter(queries).select("k1", "k2", F.col("vec_id").alias("query_id"))
        asked = scratch.table(classes.join(asking.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vector", "node"), "asked")
        part = classes.select("k1", "k2", "vector", "node")
        for _ in range(LEVELS):
            large = part.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * rows_a_part)
            some = part.join(large, "node").filter((F.xxhash64(F.lit(3), "k1", "k2") / 2.0**64 + 0.5) * F.col("n") < 1.05 * (SAMPLE + HELD))
            models = scratch.table(some.groupBy("node").applyInArrow(_fit(rows_a_part, fan, target), "node long, model binary"), "models")
            if models.isEmpty():
                break
            part, asked = scratch.table(_dealt(part, models, False), "parts"), scratch.table(_dealt(asked, models, True), "asked")
        rows_in = part.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
        asked_in = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("long").alias("askings"))
        sizes = rows_in.join(asked_in, "node")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("k2", "k1"), n)
        left = part.join(classes.select("k1", "k2", "ids"), ["k1", "k2"]).join(sizes, "node").select("node", "vector", "ids", mine("blocks").alias("block"), each("askings").alias("asking"))
        right = asked.join(sizes, "node").select("node", "k1", "k2", "vector", each("blocks").alias("block"), mine("askings").alias("asking"))
        met = left.groupBy("node", "block", "asking").cogroup(right.groupBy("node", "block", "asking"))
        found = met.applyInArrow(_compare(k + 1), "k1 long, k2 long, score double, ids array<long>")
        best = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("score", "vec_id"))
        top = found.select("k1", "k2", "score", F.explode("ids").alias("vec_id")).withColumn("rn", best).filter(F.col("rn") <= k + 1)
        lists = scratch.table(top.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")), "found")
        scratch.keep(rows)
        scratch.keep(lists)
    other = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    result = asking.join(lists, ["k1", "k2"]).select("query_id", F.posexplode(other).alias("at", "of"))
    return result.select("query_id", (F.col("at") + 1).alias("rank"), F.col("of.vec_id").alias("vec_id"), F.col("of.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector of embeddings whose vec_id is divisible by 100; see neighbours()."""
    return neighbours(common.load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
