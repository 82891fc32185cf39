"""Every query of the catalogue against its SQL."""

import pytest

from spanloom import catalog
from spanloom.operators import evaluate

from . import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        compare.same(df, compare.views(sf), catalog.ORACLES[name])
    else:
        assert df.columns
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merged_supersets(spark):
    """A superset of a gold value and a missed one of its label takes both; another label's doesn't count."""
    rows = [
        (1, "superset", "PERSON", "Maria  Rossi", "PERSON", "maria"),
        (1, "fn", None, None, "PERSON", "Rossi"),
        (1, "fn", None, None, "ORG", "Rossi"),
        (2, "superset", "PERSON", "Maria Rossi", "PERSON", "Maria"),
        (2, "fp", "ORG", "x", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, kind string, pred_label string, pred_value string, gold_label string, gold_value string")
    got = {(r.doc_id, r.kind, r.pred_label, r.gold_label) for r in evaluate.merged_supersets(df, "doc_id").collect()}
    assert got == {(1, "merged", "PERSON", "PERSON"), (1, "used", None, "PERSON"), (1, "fn", None, "ORG"), (2, "superset", "PERSON", "PERSON"), (2, "fp", "ORG", None)}
