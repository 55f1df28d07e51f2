"""Streaming forms (an extension): tumbling counts with a watermark, and a resumable sampler."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from leafmark.operators.sampling import admitted, cap
from leafmark.workers import find_us


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time_col: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, key, n, total) of each window; batch and stream alike."""
    timed = events.withWatermark(time_col, late) if events.isStreaming else events
    counted = timed.groupBy(F.window(time_col, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n", "total")


class CappedSampler(StatefulProcessor):
    """The capped sampler's state: how many rows are still wanted, and the accepted rows of
    each value of each dimension, each kept by itself, so a batch reads and writes only the
    values that it has."""

    def __init__(self, fields: list[str], names: list[str], caps: tuple[int, ...], order: str, target: int):
        self.fields, self.names, self.caps, self.order, self.target = fields, names, caps, order, target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.room = handle.getValueState("room", "room long")
        self.counts = handle.getMapState("counts", "dimension int, value string", "n long")

    def _values(self, rows: pd.DataFrame) -> list[tuple]:
        return list(rows[self.names].astype("string").astype(object).where(rows[self.names].notna(), None).itertuples(index=False, name=None))

    def _left(self) -> int:
        return self.room.get()[0] if self.room.exists() else self.target

    def _known(self, values: list[tuple]) -> Counter:
        known: Counter = Counter()
        for cell in {(d, v) for row in values for d, v in enumerate(row) if v is not None}:
            if self.counts.containsKey(cell):
                known[cell] = self.counts.getValue(cell)[0]
        return known

    def _keep(self, before: Counter, after: Counter, room: int) -> None:
        for cell, n in after.items():
            if n != before[cell]:
                self.counts.updateValue(cell, (n,))
        self.room.update((room,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order)
        room, values = self._left(), self._values(batch)
        before = self._known(values)
        used = before.copy()
        some = batch[admitted(values, self.caps, used, room)]
        self._keep(before, used, room - len(some))
        yield some[self.fields]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        """Rows that an earlier run accepted count as they are, be they more than the target or
        than a cap that was lowered since; nothing more of these is taken then."""
        values = self._values(initialState)
        before = self._known(values)
        used = before + Counter((d, v) for row in values for d, v in enumerate(row) if v is not None)
        self._keep(before, used, self._left() - len(values))


#: Keeps state by key, as the sampler's state asks for.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sample_stream(items: DataFrame, fractions: dict[str, float], order: str, target: int, accepted: DataFrame | None = None) -> DataFrame:
    """The capped sampler over a stream: accepted rows go out at once, counts are state.

    One key holds the state, as acceptance depends on all rows before: a count for each value
    of the ``target`` accepted rows at most. Feed it filtered candidates. Inside a batch rows
    are taken in ``order``; values are told apart as text. A stream that stops goes on from its
    checkpoint; where that is lost, a new one with the rows ``accepted`` so far as its state
    goes on alike.
    """
    spark, names = items.sparkSession, list(fractions)
    find_us(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    sampler = CappedSampler(items.columns, names, tuple(cap(target, f) for f in fractions.values()), order, target)
    keyed = items.withColumn("__one", F.lit(0)).groupBy("__one")
    begun = accepted.select(*names).withColumn("__one", F.lit(0)).groupBy("__one") if accepted is not None else None
    return keyed.transformWithStateInPandas(sampler, items.schema, "Append", "None", begun)
