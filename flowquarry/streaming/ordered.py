"""Cooldown on a stream in event-time order, whatever order the rows arrive in.

Rows wait in state until the watermark has passed them: only then can no earlier row come. A
timer wakes the key, its waiting rows are taken in the order of time and id, and those that
fire come out. State is the key's next ready time and its rows of the last ``late`` of event
time that could still fire; both go when the watermark has passed them. The result is that of
the batch operator on all rows that were not later than ``late``, up to the watermark.

State of this kind is held by Spark's RocksDB provider; :func:`with_ordered_state` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_ordered_state(spark: SparkSession):
    """The provider that timers and lists need, for queries started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class OrderedCooldown(StatefulProcessor):
    """Per key: ``ready``, the time from which a row fires again, and the rows that wait."""

    def __init__(self, span: int, id_type: str):
        self.span, self.id_type = span, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ready = handle.getValueState("ready", "at bigint")
        self.waiting = handle.getListState("waiting", f"at bigint, id {self.id_type}")

    def ready_at(self) -> int | None:
        return self.ready.get()[0] if self.ready.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ready, first = self.ready_at(), None
        for batch in rows:
            at = batch["at"].astype("int64")
            # Below the ready time nothing can fire any more.
            held = [(int(t), i) for t, i in zip(at, batch["id"].tolist()) if ready is None or t >= ready]
            if held:
                self.waiting.appendList(held)
                earliest = min(held)[0]
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, ready = timerValues.getCurrentWatermarkInMs() * 1000, self.ready_at()
        rows = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        fired = []
        for at, row_id in rows:
            if at < watermark and (ready is None or at >= ready):
                fired.append((at, row_id))
                ready = at + self.span
        # What is still to come may fire only at or after the ready time.
        left = [(at, i) for at, i in rows if at >= watermark and (ready is None or at >= ready)]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        elif rows:
            self.waiting.clear()
        if ready is not None and ready > watermark:
            self.ready.update((ready,))
            self.handle.registerTimer(ready // 1000 + 1)
        elif ready is not None:
            self.ready.clear()
        if fired:
            yield pd.DataFrame({"key": [key[0]] * len(fired), "id": [i for _, i in fired], "at": [a for a, _ in fired]})

    def close(self) -> None:
        pass


def ordered_cooldown(stream: DataFrame, key: str, ts: str, row_id: str, span_seconds: float, late: str = "1 hour") -> DataFrame:
    """Rows (key, row_id, ts) that fire: none has fired for its key within the span before it.

    Rows of one key at the same time fire once, as the smallest row_id. Rows later than
    ``late`` are dropped; rows within ``late`` of the newest come out when newer ones arrive.
    Rows without key or time take no part.
    """
    types = dict(stream.dtypes)
    at = F.col(ts).cast("timestamp")
    timed = stream.filter(F.col(key).isNotNull() & at.isNotNull()).select(F.col(key).alias("key"), F.col(row_id).alias("id"), at.alias("time"))
    timed = timed.withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    found = timed.groupBy("key").transformWithStateInPandas(
        OrderedCooldown(int(span_seconds * 1e6), types[row_id]), f"key {types[key]}, id {types[row_id]}, at bigint", "Append", "EventTime"
    )
    return found.select(F.col("key").alias(key), F.col("id").alias(row_id), F.timestamp_micros("at").alias(ts))
