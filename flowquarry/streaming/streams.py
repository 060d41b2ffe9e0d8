"""The batch functions on Structured Streaming, and the state streams need.

Scoring, gating, enrichment and log lines are the batch functions unchanged. Event times
are cast to timestamp before any watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowquarry.operators.windows import rate_status


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None, max_files: int = 100) -> DataFrame:
    """Files of a folder as a stream, at most ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return read_stream(spark, sf_dir, schema, pattern=f"{name}.parquet")


def event_time(c: Column) -> Column:
    return c.cast("timestamp")


def sliding_rate(stream: DataFrame, ts: str, window: str = "5 seconds", slide: str = "2 seconds", late: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per sliding window with their high/normal status; rows later than ``late``
    are dropped and state older than that is let go."""
    timed = stream.withColumn("_at", event_time(F.col(ts))).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", window, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n", rate_status(F.col("n")).alias("status"))


def tumbling_rate(stream: DataFrame, ts: str, window: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    timed = stream.withColumn("_at", event_time(F.col(ts))).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n")


def device_state(stream: DataFrame, key: str, ts: str, values: list[str], tie: str) -> DataFrame:
    """Latest values per key, for update mode. State is one row per key."""
    newest = F.max_by(F.struct(*values), F.struct(ts, tie))
    return stream.groupBy(key).agg(newest.alias("v"), F.max(F.struct(ts, tie)).alias("seen")).select(key, "v.*", F.col(f"seen.{ts}").alias(ts))


def cooldown_stream(stream: DataFrame, key: str, ts: str, row_id: str, span_seconds: float, late: str = "1 hour") -> DataFrame:
    """Rows that fire, with each key's next ready time as its only state; a key idle past
    the watermark and the span is forgotten. Rows are ordered within a micro-batch."""
    span = int(span_seconds * 1e6)
    types = dict(stream.dtypes)
    timed = stream.select(key, F.col(row_id).alias("id"), event_time(F.col(ts)).alias("at")).withWatermark("at", late)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        at = rows["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
        ready = state.get[0] if state.exists else np.iinfo(np.int64).min
        fired = []
        i = int(np.searchsorted(at, ready, side="left"))
        while i < len(at):
            fired.append(i)
            ready = int(at[i]) + span
            i = int(np.searchsorted(at, ready, side="left"))
        if ready != np.iinfo(np.int64).min:
            state.update((ready,))
            # Once the watermark passes the ready time the state says nothing more.
            state.setTimeoutTimestamp(max(ready // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = rows.iloc[fired]
        yield pd.DataFrame({"key": [group[0]] * len(out), "id": out["id"], "at": out["at"]})

    result = timed.groupBy(key).applyInPandasWithState(
        fold, f"key {types[key]}, id {types[row_id]}, at timestamp", "ready bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return result.select(F.col("key").alias(key), F.col("id").alias(row_id), F.col("at").alias(ts))


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for an availableNow query and raise its error if it has one."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def throughput(query: StreamingQuery) -> list[dict]:
    """Rows, milliseconds and rows per second of each recent micro-batch."""
    rows = []
    for p in query.recentProgress:
        ms = p.durationMs.get("triggerExecution", 0)
        rows.append({"batch": p.batchId, "rows": p.numInputRows, "ms": ms, "rows_per_second": p.numInputRows * 1000.0 / ms if ms else 0.0})
    return rows


def write_state(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Update-mode output as files tagged with their batch; :func:`read_state` keeps the last."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    values = [c for c in rows.columns if c not in (key, "_batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(key, "v.*")
