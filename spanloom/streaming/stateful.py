"""Streams with state: running budgets in event order, each text once for all time, files that a batch writes once.

State is kept by Spark's state store, in the query's checkpoint: a query that starts again goes on where it was. The
store must be RocksDB; use_state() sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import seen


def use_state(spark: SparkSession) -> SparkSession:
    """Sets the store that the queries of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


_HELD = "ts long, id string, cost double"
RUNNING = "group string, ts timestamp, id string, cost double, running double, within boolean"


class _Budget(StatefulProcessor):
    """Rows of a group wait until the watermark has passed them, and then count in the order of (ts, id)."""

    def __init__(self, cap: float):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent double")
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = []
        for part in rows:
            part = part[["ts", "id", "cost"]]
            if len(part):
                ts = part["ts"].astype("datetime64[us]").astype("int64")
                self.held.appendList(list(zip(ts.tolist(), part["id"].tolist(), part["cost"].tolist(), strict=True)))
                times.append(int(ts.min()))
        if times:
            # a timer fires when the watermark has passed it
            self.handle.registerTimer(max(min(times) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get())
        due, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        spent = self.spent.get()[0] if self.spent.exists() else 0.0
        found = []
        for ts, id_, cost in due:
            found.append((key[0], pd.Timestamp(ts, unit="us"), id_, cost, spent + cost, spent < self.cap))
            spent += cost
        self.spent.update((spent,))
        self.held.clear()
        if later:
            self.held.appendList(later)
            self.handle.registerTimer(max(later[0][0] // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        if found:
            yield pd.DataFrame(found, columns=[f.split()[0] for f in RUNNING.split(", ")])

    def close(self) -> None:
        pass


def running_budget(calls: DataFrame, cap: float, lateness: str = "1 hour") -> DataFrame:
    """As costs.budgeted(), of a stream of calls (group, ts, id, cost): running, a group's cost up to and with the call in the order of (ts, id), and within, whether the budget held before it.

    A call is given once the watermark, ``lateness`` behind the newest, has passed it, in whatever order calls came;
    those that come later than that are left out, as with any watermark. A null group or ts is left out, a null cost
    counts as nothing, a null id as an empty one. A group holds the calls of its last ``lateness`` in its state.
    """
    rows = calls.filter("group is not null and ts is not null").select(F.col("group").cast("string").alias("group"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    grouped = rows.withWatermark("ts", lateness).groupBy("group")
    return grouped.transformWithStateInPandas(statefulProcessor=_Budget(cap), outputStructType=T._parse_datatype_string(RUNNING), outputMode="Append", timeMode="EventTime")


class _Once(StatefulProcessor):
    """The first row of a text that was not there before."""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean", ttlDurationMs=self.days * 86_400_000 if self.days else None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            for row in part.itertuples(index=False):
                if first is None or (row.order, row.packed) < first:
                    first = row.order, row.packed
        if first is not None and not self.known.exists():
            self.known.update((True,))
            yield pd.DataFrame({"packed": [first[1]]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def once(texts: DataFrame, text: str = "text", order: str = "doc_id", days: int | None = None) -> DataFrame:
    """The rows of a stream whose text was never there before, however long ago: of a batch the first in ``order`` (a null first), ties by their contents. A null text is one, too. The state has a digest for each text; days: after so many it is forgotten."""
    packed = F.to_json(F.struct(*(F.col(f"`{c}`") for c in texts.columns)), {"ignoreNullFields": "false"})
    place = F.col(order).cast("string")
    if texts.schema[order].dataType.typeName() in ("long", "integer", "short", "byte"):
        # whole numbers in the order of their digits
        place = F.lpad((F.col(order).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    rows = texts.select(seen.digest(F.col(text)).alias("digest"), F.coalesce(place, F.lit("")).alias("order"), packed.alias("packed"))
    firsts = rows.groupBy("digest").transformWithStateInPandas(statefulProcessor=_Once(days), outputStructType=T._parse_datatype_string("packed string"), outputMode="Append", timeMode="ProcessingTime" if days else "None")
    return firsts.select(F.from_json("packed", texts.schema).alias("r")).select("r.*")


def write_batch(path: str, form: str = "json"):
    """For writeStream.foreachBatch: a batch's rows below ``path`` in a folder of its own, which a batch that is run again replaces, so that none is written twice or in part."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").format(form).save(f"{path}/batch={batch}")

    return write
