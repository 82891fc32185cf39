"""Results of the two engines as sorted rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows_of(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, con, sql):
    """Asserts equal columns and rows."""
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns, order) == rows_of(found.fetchall(), found.columns, order)
