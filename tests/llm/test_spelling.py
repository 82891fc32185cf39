"""13 against all pairs of words and a plain reading of the texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from spanloom.llm import spelling_variants as spelling

from .. import compare

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows, divisor=199):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if divisor and h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters)


def plain(rows, divisor=199):
    n = plain_words(rows, divisor)
    letters = {c for w in n for c in w}
    forms, result = {}, {}
    for w in n:
        near = sorted({v for v in edits(w, letters) if v in n and v != w}, key=lambda v: (-n[v], v))
        forms[w] = near[0] if near and n[near[0]] >= 5 * n[w] else None
        result[w] = (n[w], len(near), forms[w], n.get(forms[w]))
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        result[w] += (root,)
    return result


def got(df):
    rows = df.collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert sum(v[1] > 0 for v in want.values()) > 20
    assert got(spelling.op13_spelling_variants(spark, sf)) == want


def test_sql(spark, sf):
    compare.same(spelling.op13_spelling_variants(spark, sf), compare.views(sf), spelling.ORACLE)


def made_docs():
    """Words of few letters with many near ones, chains of forms, Latin-1 letters and what surrounds them."""
    rng = random.Random(2)
    some = ["".join(rng.choices("abÿ×", k=rng.randrange(6, 9))) for _ in range(150)]
    chain = ["abcdefgh", "abcdefg", "abcdefgx", "abcdexgx"]
    texts = [" ".join(rng.choices(some, k=400)) for _ in range(10)]
    texts += [" ".join([w] * n) for w, n in zip(chain, (5000, 900, 150, 20), strict=True)]
    texts += [None, "", "  ", "Straße straße STRASSE İstanbul étééééé \U0001f600abcdefgh9abcdefgh_" * 6, "x" * 30_000 + " " + "x" * 29_999 + " "]
    return [(k % 7 if k % 5 else None, t) for k, t in enumerate(texts)] + [(3, ("x" * 30_000 + " ") * 5 + ("x" * 29_999 + " ") * 30)]


@pytest.mark.parametrize(("a_node", "block"), [(4, 40_000), (20_000, 60)])
def test_edges(spark, a_node, block):
    rows = made_docs()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, code string, n long, node string")
    want = plain(rows)
    assert {w[4] for w in want.values() if w[2] == "abcdefgx"} == {"abcdefgh"} or "abcdexgx" in want
    assert got(spelling.variants(docs, divisor=199, words_a_node=a_node, block=block)) == want


def test_without_damage_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "colour " * 50 + "color. " * 9 + "colours " * 10)], "doc_id long, text string")
    assert got(spelling.variants(docs)) == {"colour": (50, 1, None, None, "colour"), "colours": (10, 1, "colour", 50, "colour")}
    assert got(spelling.variants(docs.filter("false"))) == {}
    with pytest.raises(ValueError, match="frequent"):
        spelling.variants(docs, ratio=1)
