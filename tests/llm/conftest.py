import pytest

#: Names that the operators might use themselves.
CLASHING = ["k1", "k2", "key", "band", "row", "cut", "statistics", "verdict", "copies", "found", "n_words", "_k1", "_k2", "bin", "bounds"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def passage(n, seed=0):
    """n words, different for each seed."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}x{seed}" for i in range(n))


EDGES = [
    (1, ""),
    (2, None),
    (None, passage(50, 1) + " end"),
    (3, "word"),
    (4, passage(30000, 2)),
    (5, passage(80, 3)),
    (6, passage(80, 3)),
    (7, passage(60, 4)),
    (7, passage(60, 4)),
    (8, "a  double  space\tand\ttabs \n\n line \U0001f600 ▁ mark <|endoftext|> x"),
    (9, "   \n\t "),
    (10, "A b c"),
    (11, "a B c"),
    (12, "\x01 \x00 ctrl"),
    (13, passage(3, 5) + " " + passage(40, 6) + " " + passage(3, 7)),
    (14, passage(4, 8) + " " + passage(40, 6) + " " + passage(4, 9)),
    (15, " ".join(["loop"] * 100)),
    (16, "Ünïcode ẞ straße İstanbul ΣΟΦΟΣ 日本語 " + passage(20, 10)),
    (None, None),
    (17, passage(80, 3).replace("w", "W")),
    (18, " leading and trailing "),
]


def rows_of(texts):
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if t is None else len(t), *["x"] * len(CLASHING)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(rows_of(EDGES), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    """The smallest documents table, as (doc_id, text) too."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, sorted((r.doc_id, r.text) for r in df.collect())
