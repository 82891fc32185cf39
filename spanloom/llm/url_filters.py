"""10. URL rules: host-suffix and path-prefix expressions, joined on short hashes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest by which expressions and rules are joined.
SHORT = 8
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty where the url is null or has no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """Of both, kept apart by a character that no host has."""
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The suffixes of the host that have one of the numbers of labels, each followed by all prefixes of the path that have one of the lengths: as many at most as rules differ in these, however long the url."""
    parts = F.split(host, r"\.")
    few = lambda numbers, most: F.filter(F.array(*map(F.lit, numbers)).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(few(labels, F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(few(lengths, F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("rule"), F.length(s).alias("host_size"), _digest(s, p).alias("digest")))))


def judged(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url; other columns are left out).

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains, if the page's path starts
    with the rule's. The longest fitting rule wins; of equally long ones that with the longer host; of equal rules
    block. Rules with a null are left out, and their hosts' A-Z are lower-cased as urls' are. Rows that repeat are judged
    alike; a url that is null or has no ``://`` has an empty host and path, which no rule with a host fits. A url of any
    length is looked up as often as rules differ in their hosts' numbers of labels and their paths' lengths, which are
    what reaches the driver. No rows give none.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # as many as a path has characters and a host has labels at most
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = [r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect()]
    digest = _digest(F.col("host"), F.col("path"))
    rules = rules.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("full"), "verdict")
    urls = rows.select("host", "path").distinct()
    found = urls.select("host", "path", F.inline(expressions(F.col("host"), F.col("path"), labels or [1], lengths or [0])))
    found = found.select("*", F.substring("digest", 1, SHORT).alias("short"))
    found = found.join(rules, "short").filter(F.col("digest") == F.col("full"))
    best = F.max(F.struct(F.length("rule").alias("size"), "host_size", "rule", "verdict"))
    found = found.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(common.load(spark, sf_dir, "pages"), rules)


ORACLE = """
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, k, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT p.k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS o
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.k = m.k AND m.o = 1
"""
