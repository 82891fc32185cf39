"""Streams with state, stopped and started again from their checkpoints."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import costs
from spanloom.streaming import stateful

CALLS = "group string, ts timestamp, id string, cost double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """(put, run): adds a file of rows, and runs a query of the files so far to its end from one checkpoint, giving all that it ever wrote."""
    stateful.use_state(spark)
    (tmp_path / "in").mkdir()
    count = [0]

    def put(rows):
        count[0] += 1
        file = tmp_path / "in" / f"{count[0]:03}.json"
        file.write_text("".join(json.dumps(r) + "\n" for r in rows))
        # files are taken by age
        os.utime(file, (1_700_000_000 + count[0],) * 2)

    def run(schema, make):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = make(rows).writeStream.outputMode("append").foreachBatch(stateful.write_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        out = make(rows).schema
        return spark.read.schema(out).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(str(tmp_path / "out")).collect()

    yield put, run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_running_budget(spark, stream):
    """Calls out of order, over two runs: as the table's, once the watermark has passed them."""
    put, run = stream
    rng = random.Random(1)
    calls = [(rng.choice("ab"), START + dt.timedelta(minutes=k), f"{k:03}", rng.randrange(1, 9) / 4) for k in range(120)]
    rows = [{"group": g, "ts": t.isoformat(), "id": i, "cost": c} for g, t, i, c in calls]
    blocks = [rows[k : k + 20] for k in range(0, 120, 20)]
    for block in blocks:
        rng.shuffle(block)
    make = lambda df: stateful.running_budget(df, 30.0, "30 minutes")
    for block in blocks[:3]:
        put(block)
    first = run(CALLS, make)
    for block in blocks[3:]:
        put(block)
    put([{"group": "z", "ts": (START + dt.timedelta(days=2)).isoformat(), "id": None, "cost": None}, {"group": None, "ts": None, "id": "x", "cost": 1.0}])
    found = run(CALLS, make)
    want = {(r.group, r.id): (r.running, r.within) for r in costs.budgeted(spark.createDataFrame(calls, CALLS), "group", ["ts", "id"], "cost", 30.0).collect()}
    got = {(r.group, r.id): (r.running, r.within) for r in found if r.group != "z"}
    assert 0 < len(first) < len(got) == len([r for r in found if r.group != "z"]) == 120
    assert got == {k: (pytest.approx(a), b) for k, (a, b) in want.items()}
    assert not all(b for _, b in got.values())


def test_each_text_once(stream):
    """Across files, and across a restart long after."""
    put, run = stream
    schema = "doc_id long, text string, more array<int>"
    row = lambda i, t: {"doc_id": i, "text": t, "more": [1, None]}
    put([row(5, "a"), row(3, "a"), row(4, None), row(7, "b")])
    put([row(1, "a"), row(8, "c")])
    make = lambda df: stateful.once(df)
    assert sorted((r.doc_id, r.text) for r in run(schema, make) if r.text) == [(3, "a"), (7, "b"), (8, "c")]
    put([row(9, "b"), row(10, None), row(-2, "d"), row(2, "d"), row(11, "")])
    found = run(schema, make)
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted([(3, "a"), (4, None), (7, "b"), (8, "c"), (-2, "d"), (11, "")], key=str)
    assert all(r.more == [1, None] for r in found)


def test_a_batch_again_replaces_its_files(spark, tmp_path):
    write = stateful.write_batch(str(tmp_path))
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(3, 5), 1)
    assert sorted(r.id for r in spark.read.json(str(tmp_path)).select("id").collect()) == [0, 1, 2, 3, 4]
    assert spark.read.json(str(tmp_path)).agg(F.count_distinct("batch")).first()[0] == 2
