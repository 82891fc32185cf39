"""Vectors of token spans from their documents' token vectors: sums up to each token once, then two reads for a span of any width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_spans(hidden: np.ndarray, ts: np.ndarray, te: np.ndarray) -> np.ndarray:
    """The vectors of both ends and the mean between them, of spans within a document's tokens (a row of hidden each)."""
    sums = np.concatenate([np.zeros((1, hidden.shape[1])), np.cumsum(hidden, axis=0)])
    return np.hstack([hidden[ts], hidden[te], (sums[te + 1] - sums[ts]) / (te - ts + 1)[:, None]])


def spanned(hidden: Column, ts: Column, te: Column, widths: list[list[float]] | None = None) -> Column:
    """An array of the vectors of a document's spans: arrays ts and te over hidden, an array of token vectors. Null for a span that isn't within the tokens.

    widths: a vector for each width from 1 on that is put behind a span's own; wider spans have the last.
    """
    table = np.array(widths, float) if widths else None

    def batches(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in it:
            rows = []
            for vectors, first, last in zip(*(c.to_pylist() for c in columns), strict=True):
                h = np.array(vectors or [], float)
                a, b = (np.array([-1 if x is None else x for x in side or []], np.int64) for side in (first, last))
                good = (a >= 0) & (a <= b) & (b < len(h))
                found: list = [None] * len(a)
                if good.any():
                    made = of_spans(h, a[good], b[good])
                    if table is not None:
                        made = np.hstack([made, table[np.minimum(b[good] - a[good], len(table) - 1)]])
                    for k, vector in zip(np.flatnonzero(good).tolist(), made.tolist(), strict=True):
                        found[k] = vector
                rows.append(found)
            yield pa.array(rows, pa.list_(pa.list_(pa.float64())))

    batches.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<array<double>>")(hidden, ts, te)


def represented(docs: DataFrame, spans: DataFrame, key: str, widths: list[list[float]] | None = None) -> DataFrame:
    """key, ts, te, vector of the token spans (key, ts, te) over docs (key, hidden); a document's token vectors meet its spans once. See spanned()."""
    lists = spans.groupBy(key).agg(F.collect_list(F.struct("ts", "te")).alias("spans"))
    rows = docs.select(key, "hidden").join(lists, key)
    rows = rows.select(key, "spans", spanned(F.col("hidden"), F.col("spans.ts"), F.col("spans.te"), widths).alias("vectors"))
    each = rows.select(key, F.explode(F.arrays_zip("spans", F.col("vectors").alias("vector"))).alias("z"))
    return each.select(key, "z.spans.ts", "z.spans.te", "z.vector")
