"""What every micro-batch took, kept by a listener: a query's own progress forgets old batches."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, rows long, ms long, rows_per_second double"
#: Batches held in memory before they are written out.
HELD = 1000


class LatencyRecord(StreamingQueryListener):
    """One row a batch, for all queries of the session while it is attached."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.held: list[tuple] = []
        self.running: set[str] = set()
        self.seen_end = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.seen_end:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ms = int(p.durationMs.get("triggerExecution", 0))
        with self.seen_end:
            self.held.append((str(p.runId), p.batchId, p.numInputRows, ms, p.numInputRows * 1000.0 / ms if ms else 0.0))
            full = len(self.held) >= HELD
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.seen_end:
            self.running.discard(str(event.runId))
            self.seen_end.notify_all()

    def flush(self) -> None:
        with self.seen_end:
            rows, self.held = self.held, []
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, seconds: float = 30.0) -> None:
        """Events come on their own thread: until every started query's end has been told."""
        with self.seen_end:
            self.seen_end.wait_for(lambda: not self.running, seconds)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


@contextmanager
def recorded(spark: SparkSession, path: str) -> Iterator[LatencyRecord]:
    """Record the queries that run inside; leaves when they have ended."""
    record = LatencyRecord(spark, path)
    spark.streams.addListener(record)
    try:
        yield record
        record.wait()
    finally:
        spark.streams.removeListener(record)
        record.flush()
