"""8 and 10 against SQL, and archives byte by byte."""

import gzip
import hashlib

import pytest

from spanloom.llm import common, url_filters, warc

from .. import compare


def test_warc(spark, sf):
    compare.same(warc.op8_warc(spark, sf), compare.views(sf), warc.ORACLE)


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (2, "http://b/", "same"), (None, "http://n/", "same"), (5, "http://d/", "\x1f\x8b\x08 é\x00 WARC/1.1"), (6, "u", "x" * 3_000_000), (None, None, "alone")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, keeper string")


@pytest.mark.parametrize("range_bytes", [1, 300, 4 << 20])
def test_warc_ranges(spark, range_bytes):
    rows = PAGES if range_bytes > 1 else PAGES[:5]
    archives = warc.write(pages(spark, rows).coalesce(1), common.scratch_path(spark, "warc"), archive_bytes=2000)
    got = warc.read(archives, range_bytes=range_bytes).collect()
    texts = {}
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), str(r[-1]))
    want = []
    for i, url, html in rows:
        body = (html or "").encode()
        equal = [j for j, _, h in rows if (h or "").encode() == body]
        keeper = max((j for j in equal if j is not None), default=None)
        texts[i] = url
        want.append((i, "response" if i == keeper else "revisit", None if i == keeper else keeper, len(body), warc.digest_of(body)))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=key) == sorted(want, key=key)
    assert all(r.payload == dict((j, (h or "").encode()) for j, _, h in rows)[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_warc_least_bytes_and_empty(spark):
    archives = warc.write(pages(spark, PAGES[:5]), common.scratch_path(spark, "warc"), least_bytes=5)
    assert {r.record_type for r in warc.read(archives, payloads=False).collect()} == {"response"}
    none = warc.write(pages(spark, PAGES).filter("false"), common.scratch_path(spark, "warc"))
    assert warc.read(none).count() == 0


def test_reading_tasks_grow_with_ranges(spark):
    archives = warc.write(pages(spark, [(i, "http://h/", "".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest() for k in range(100))) for i in range(40)]).coalesce(1), common.scratch_path(spark, "warc"), archive_bytes=20_000)
    sizes = [r.bytes for r in archives.collect()]
    assert len(sizes) > 1
    for range_bytes in (500, 3000, 1 << 20):
        read = warc.read(archives, range_bytes=range_bytes)
        assert read.rdd.getNumPartitions() == sum(-(-n // range_bytes) for n in sizes)
        assert sorted(r.page_id for r in read.collect()) == list(range(40))


def test_magic_inside_a_member():
    """Bytes that look like a member's start, inside one that isn't compressed, are no record of their own."""
    inner = gzip.compress(warc.record(9, "http://inner/", b"inner", warc.digest_of(b"inner"), None))
    member = lambda i, body: gzip.compress(warc.record(i, "http://o/", body, warc.digest_of(body), None), 0, mtime=0)
    data = member(1, b"\x1f\x8b\x08" * 50 + inner + b"tail") + member(2, b"next")

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    for size in (7, 64, 1000):
        found = [warc.parse(raw)[0] for start in range(0, len(data), size) for _, raw in warc.members(warc._Source(File(), len(data)), start, start + size)]
        assert found == [1, 2]


def test_url_filters(spark, sf):
    compare.same(url_filters.op10_url_filters(spark, sf), compare.views(sf), url_filters.ORACLE)


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://xexample.com/en/", "https://a.b.net/fr/1?q=/es/", "net/es/", None, "http://net", "http://net?x", "ftp://net/es/#a", "http://com/", "x://.com/a", "http://example.com:80/en/", "http://net/es/", "http://net/es/"]
    rules = spark.createDataFrame([*url_filters.RULES, ("com", "/", "block"), ("org", "", "block"), ("ab.org", "/p", "allow"), ("b.org", "/pq", "block"), (None, "/", "block")], "host string, path string, verdict string")
    rows = [(i, u) for i, u in enumerate([*urls, "http://ab.org/pq", "http://b.org", "http://x.b.org/pqr"])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, rule string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(df, rules).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("com/", "block") and got[3] == ("a.b.net", "/fr/1", "net/fr/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == got[7] == ("net", "", None, "allow")
    assert got[8] == ("net", "/es/", "net/es/", "block") and got[9][2] == "com/" and got[11][2:] == (None, "allow") and got[12] == got[13]
    assert got[14][2:] == ("ab.org/p", "allow") and got[15][2:] == ("org", "block") and got[16][2:] == ("b.org/pq", "block")
    assert url_filters.judged(df.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_filters.judged(df, rules.filter("false")).collect()} == {"allow"}
    many = spark.createDataFrame([(1, "http://" + "a." * 5000 + "EXAMPLE.com/en/x"), (2, "http://" + "x" * 20000 + ".net/fr/" + "p/" * 5000)], "page_id long, url string")
    capital = spark.createDataFrame([("Example.COM", "/en/", "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.judged(many, capital).collect()} == {1: ("example.com/en/", "block"), 2: ("net/fr/", "block")}


def test_rules_that_join_to_one_text(spark):
    """Host and path of a rule stay apart: "a.b" with "c/" is not "a.bc" with "/"."""
    rules = spark.createDataFrame([("a.b", "c/", "block"), ("a.bc", "/", "allow"), ("a.bd", "/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.bc/x"), (2, "http://a.b/c/"), (3, "http://a.bd/c/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judged(df, rules, default="none").collect()}
    assert got == {1: ("a.bc/", "allow"), 2: (None, "none"), 3: ("a.bd/", "block")}
