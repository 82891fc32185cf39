"""Rows by their places, objects over blocks of files, histories of texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom import shared
from spanloom.plans import exchange
from spanloom.sources import concatenated, positions, records, seen


@pytest.fixture
def set_conf(spark):
    """Sets Spark settings for a test."""
    before = {}

    def put(**conf):
        for name, value in conf.items():
            name = name.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def wide(spark, n, seed):
    """n rows of 512 characters, in no order."""
    return spark.range(n, numPartitions=10).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**40))).alias("key"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("text"))


def test_numbered_wide_rows(spark, set_conf):
    """40,000 rows whose partitions adaptive execution joins: each place once, in order, whatever is read of them."""
    set_conf(spark__sql__shuffle__partitions="8", spark__sql__adaptive__advisoryPartitionSizeInBytes="1m")
    rows = positions.numbered(wide(spark, 40_000, 1), ["key"])
    assert rows.agg(F.count(F.lit(1)), F.min("_row"), F.max("_row"), F.count_distinct("_row")).first()[:] == (40_000, 0, 39_999, 40_000)
    assert [r.key for r in rows.orderBy("_row").select("key").collect()] == sorted(r.key for r in wide(spark, 40_000, 1).select("key").collect())
    back = spark.read.parquet(str(_written(rows)))
    assert back.count() == 40_000 and back.agg(F.count_distinct("_row")).first()[0] == 40_000


def _written(df):
    path = shared.new_path(df.sparkSession, "test")
    df.write.parquet(path)
    return path


def test_companions_of_wide_rows(spark, set_conf):
    set_conf(spark__sql__shuffle__partitions="8")
    main = wide(spark, 40_000, 1)
    side = main.select("key", F.array(F.struct(F.col("id").alias("start"))).alias("sensitivity_spans"))
    found = positions.with_companion(main, side, ["key"])
    assert found.agg(F.count(F.lit(1)), F.count_if(F.col("sensitivity_spans")[0]["start"] == F.col("id"))).first()[:] == (40_000, 40_000)


def test_rows_of_files_in_order(spark, tmp_path, set_conf):
    """Two files in no sorted order, blank lines, wide rows and small blocks."""
    rng = random.Random(3)
    ids = list(range(3000))
    rng.shuffle(ids)
    gold, pred = tmp_path / "gold", tmp_path / "pred"
    gold.mkdir(), pred.mkdir()
    line = lambda **row: json.dumps(row) + "\n" * rng.randrange(1, 4)
    for folder, files, make in ((gold, 2, lambda i: line(id=i, text="x" * rng.randrange(900))), (pred, 7, lambda i: line(of=i))):
        size = -(-len(ids) // files)
        for k in range(files):
            (folder / f"part-{k:02}.jsonl").write_text("".join(make(i) for i in ids[k * size : (k + 1) * size]))
    set_conf(spark__sql__files__maxPartitionBytes="64k", spark__sql__files__openCostInBytes="1k")
    a, b = positions.read_numbered(spark, str(gold), "id long, text string"), positions.read_numbered(spark, str(pred), "of long")
    assert [r.id for r in a.orderBy("_row").collect()] == ids
    rows = positions.paired(b, a).orderBy("_row").collect()
    assert [(r._row, r.gold.id, r.pred.of) for r in rows] == [(k, i, i) for k, i in enumerate(ids)]
    with pytest.raises(ValueError, match="3000 predictions and 2999 gold rows"):
        positions.paired(b, a.filter("_row < 2999"))
    with pytest.raises(ValueError, match="rows and 2999 companions"):
        positions.with_companion(a, a.filter("_row < 2999"))
    assert positions.read_numbered(spark, [str(gold / "part-01.jsonl")], "id long").count() == 1500


def test_arrived(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r.v for r in positions.arrived(df).orderBy("_row").collect()] == [i * 7919 % 1000 for i in range(1000)]
    assert positions.arrived(df.filter("false")).count() == 0 and positions.numbered(df.filter("false"), ["v"]).count() == 0


def objects(rng, n):
    tricky = ['"', "\\", "{", "}", "[", "]", "\n", "é", "\U0001f600", ",", " ", "a"]
    return [{"id": k, "text": "".join(rng.choices(tricky, k=rng.randrange(40))), "of": rng.choice([None, {"x": [{"y": 1}, {}]}, []])} for k in range(n)]


def plain(text):
    decoder, at, found = json.JSONDecoder(), 0, []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return found
        one, at = decoder.raw_decode(text, at)
        found += one if isinstance(one, list) else [one]


def test_concatenated_objects_over_blocks(spark, tmp_path, set_conf):
    rng = random.Random(4)
    forms = [lambda o: json.dumps(o, indent=2), lambda o: json.dumps(o), lambda o: json.dumps(o, indent=1, ensure_ascii=False)]
    texts = ["\n".join(rng.choice(forms)(o) for o in objects(rng, 80)), "".join(json.dumps(o) for o in objects(rng, 60)), json.dumps(objects(rng, 50), indent=4) + "\n" + json.dumps(objects(rng, 1)), "", " \n", "[]", json.dumps({"id": 1, "text": "z" * 20_000})]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
    set_conf(spark__sql__files__maxPartitionBytes="700", spark__sql__files__openCostInBytes="1", spark__sql__shuffle__partitions="4")
    scan = spark.read.option("lineSep", "}").text(str(tmp_path))
    small = scan.rdd.getNumPartitions()
    assert small > 30
    found = {}
    for r in concatenated.read_objects(spark, str(tmp_path)).collect():
        found.setdefault(int(r.path.rsplit("/f", 1)[1][0]), {})[r.idx] = json.loads(r.value)
    for k, text in enumerate(texts):
        assert [v for _, v in sorted(found.get(k, {}).items())] == plain(text), k
        assert sorted(found.get(k, {})) == list(range(len(plain(text))))
    set_conf(spark__sql__files__maxPartitionBytes="7000")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() < small


@pytest.mark.parametrize("text", ['{"a": 1', '{"a": 1} x {"a": 2}', '{"a": 1}}', '1 {"a": 1}', "[1, 2]", '{"a": "}'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="JSON must be objects"):
        concatenated.read_objects(spark, str(tmp_path / "f.json")).collect()


def test_pretty_roundtrip(spark, tmp_path):
    records.write_pretty(spark.createDataFrame([(k, '{"\\}') for k in range(50)], "id long, text string").repartition(2), str(tmp_path / "p"))
    assert sorted(r.id for r in records.read_concatenated(spark, str(tmp_path / "p"), "id long, text string").collect()) == list(range(50))


ROWS = [(1, "a", 0), (2, "a", 0), (3, None, 0), (4, None, 0), (None, "b", 1), (None, "b", 2), (5, "c", 0), (5, "c", 0), (6, "", 0), (None, "d", 0), (7, "d", 0), (8, "old", 0)]
SCHEMA = "doc_id long, text string, other int"


def test_unseen(spark):
    new, old = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(0, "old", 0)], SCHEMA)
    found = sorted(((r.doc_id, r.text) for r in seen.unseen(new, old).collect()), key=str)
    assert found == sorted([(1, "a"), (3, None), (None, "b"), (5, "c"), (6, ""), (7, "d")], key=str)
    assert None not in {r.text for r in seen.unseen(new, old.union(spark.createDataFrame([(0, None, 0)], SCHEMA))).collect()}
    assert seen.unseen(new.filter("false"), old).count() == 0


def test_history(spark, tmp_path):
    """A missing history is empty; a second run reads only the folders of its own prefixes, and adds nothing twice."""
    path = str(tmp_path / "history")
    new = spark.createDataFrame(ROWS, SCHEMA)
    assert seen.scan(spark, path)[0] == 0
    first = seen.resumed(new, path)
    kept = {r.text for r in first.collect()}
    assert kept == {"a", None, "b", "c", "", "d", "old"}
    seen.remember(first, path)
    seen.remember(first, path)
    assert seen.scan(spark, path)[0] == 7
    assert seen.resumed(new, path).count() == 0
    more = spark.createDataFrame([(9, "new", 0), (10, "a", 0)], SCHEMA)
    assert [(r.doc_id, r.text) for r in seen.resumed(more, path).collect()] == [(9, "new")]
    folders = seen.touched(spark, path, more.select(seen.digest(F.col("text")).alias("digest")))
    files = {f.split("prefix=")[1][:3] for (f,) in folders.select("_metadata.file_path").distinct().collect()}
    assert files == {r[0] for r in more.filter("text = 'a'").select(F.substring(seen.digest(F.col("text")), 1, 3)).collect()}
    assert "PartitionFilters: [prefix" in folders._jdf.queryExecution().toString()


def test_release(spark):
    table = shared.written(spark.range(3), "x")
    assert table.count() == 3
    shared.release(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        table.count()


def test_pieces_of_a_block_meet_in_runs(spark, tmp_path, monkeypatch):
    """A block's pieces are counted in runs, over several tasks; before, all text of a block went to one."""
    monkeypatch.setattr(concatenated, "PIECES", 5)
    rows = objects(random.Random(5), 120)
    (tmp_path / "f.json").write_text("\n".join(json.dumps(o, indent=2) for o in rows), encoding="utf-8")
    found = concatenated.read_objects(spark, str(tmp_path / "f.json"))
    assert [json.loads(r.value) for r in found.orderBy("idx").collect()] == rows
    assert re.search(r"hashpartitioning\(path#\d+, block#\d+L, run#\d+L", found._jdf.queryExecution().executedPlan().toString())


def test_more_parts_are_written_to_more_files(spark, tmp_path, set_conf):
    spark.range(40).selectExpr("id as doc_id", "repeat('x', 10) as text").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    set_conf(spark__sql__files__maxPartitionBytes="2000", spark__sql__files__openCostInBytes="1")
    parts = exchange.X.documents(spark, str(tmp_path)).rdd.getNumPartitions()
    before = set(shared._written.get(id(spark.sparkContext), []))
    assert parts > 3 and exchange.concatenated_json(spark, str(tmp_path)).count() == 40
    (path,) = [p for p in set(shared._written[id(spark.sparkContext)]) - before if "/pretty-" in p]
    assert len(records.matching(spark, f"{path}/part-*")) == parts
