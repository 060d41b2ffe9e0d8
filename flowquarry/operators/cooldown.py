"""Cooldown suppression: a row fires if its key has not fired within the span before it.

Each firing depends on the one before, but a stretch of time can be summed up without
knowing that history: for every moment the key may become ready again, when would it be
ready after the stretch? Stretches are summed up in parallel, the short summaries of a
key are chained in order, and every stretch then replays from its known start. A key
with a third of all rows is thus spread over all its stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_STRETCH = 50_000
# Paths meet within a few spans, so a dense key gets stretches of several spans, up to
# this many rows, to keep the summaries short.
SPANS_PER_STRETCH = 8
MOST_ROWS_PER_STRETCH = 5_000_000


def _jumps(ts: np.ndarray, span: int) -> np.ndarray:
    """Index of the first row each firing lets through next; len(ts) if none."""
    return np.searchsorted(ts, ts + span, side="left")


def _summary(ts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (ready, after): a key ready by ``ready[i]`` but not by ``ready[i-1]`` fires in
    this stretch so that it is next ready at ``after[i]``. Steps with equal ends are merged,
    which leaves few, as paths soon meet."""
    nxt = _jumps(ts, span)
    after = np.empty(len(ts), dtype=np.int64)
    for i in range(len(ts) - 1, -1, -1):
        after[i] = ts[i] + span if nxt[i] == len(ts) else after[nxt[i]]
    last = np.append(after[1:] != after[:-1], True)
    return ts[last], after[last]


def _replay(ts: np.ndarray, ready: int, span: int) -> np.ndarray:
    fired = []
    i = int(np.searchsorted(ts, ready, side="left"))
    nxt = _jumps(ts, span)
    while i < len(ts):
        fired.append(i)
        i = int(nxt[i])
    return np.array(fired, dtype=np.int64)


def cooldown(df: DataFrame, key: str, ts: str, row_id: str, span: str, rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """The rows (key, ts, row_id) that fire. Rows of one key at the same time fire once,
    as the smallest row_id. Keys and times must not be null."""
    spark = df.sparkSession
    micros = int(spark.sql(f"select cast(interval {span} as interval day to second) s").collect()[0][0].total_seconds() * 1e6)
    key_type = dict(df.dtypes)[key]
    # Equal times can fire only once: keep one row for each before anything else.
    rows = df.groupBy(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).agg(F.min(row_id).alias("id"))
    spans = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    few = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_stretch))
    fewest = F.greatest(F.lit(1), F.ceil(F.col("n") / max(rows_per_stretch, MOST_ROWS_PER_STRETCH)))
    length = F.col("hi") - F.col("lo")
    width = F.greatest(
        F.floor(length / few) + 1, F.least(F.lit(SPANS_PER_STRETCH * micros), F.floor(length / fewest) + 1)
    )
    spans = spans.select("k", "lo", width.alias("width"), (length >= width).alias("long"))
    sized = rows.join(spans, "k")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ready = None, 0
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for i, (k, t) in enumerate(zip(pdf["k"].tolist(), pdf["t"].tolist())):
                if k != current or t >= ready:
                    keep[i], current, ready = True, k, t + micros
            yield pdf[keep]

    out = f"k {key_type}, t bigint, id {dict(df.dtypes)[row_id]}"
    # Keys of one stretch stream through their task in order, many keys to a task.
    short = sized.filter("not long").select("k", "t", "id")
    short = short.repartition("k").sortWithinPartitions("k", "t").mapInPandas(fold, out)
    # floor(a / b) on longs beyond 2^53 would round: integer division keeps stretches exact.
    cut = sized.filter("long").withColumn("stretch", F.expr("(t - lo) div width")).select("k", "stretch", "t", "id")

    def summarise(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ready, after = _summary(np.sort(pdf["t"].to_numpy(dtype=np.int64)), micros)
        return pd.DataFrame({"k": group[0], "stretch": group[1], "ready": [ready.tolist()], "after": [after.tolist()]})

    summaries = cut.select("k", "stretch", "t").groupBy("k", "stretch").applyInPandas(
        summarise, f"k {key_type}, stretch bigint, ready array<bigint>, after array<bigint>"
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ready = None, 0
        for pdf in batches:
            starts = np.empty(len(pdf), dtype=np.int64)
            for i, (k, steps, after) in enumerate(zip(pdf["k"], pdf["ready"], pdf["after"])):
                if k != current:
                    current, ready = k, np.iinfo(np.int64).min
                starts[i] = ready
                j = int(np.searchsorted(steps, ready, side="left"))
                if j < len(steps):
                    ready = int(after[j])
            yield pd.DataFrame({"k2": pdf["k"], "s2": pdf["stretch"], "start": starts})

    # Summaries of one key are few; batches stream through in order.
    chained = summaries.repartition("k").sortWithinPartitions("k", "stretch").mapInPandas(
        chain, f"k2 {key_type}, s2 bigint, start bigint"
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        fired = _replay(pdf["t"].to_numpy(dtype=np.int64), int(pdf["start"].iloc[0]), micros)
        return pdf.iloc[fired][["k", "t", "id"]]

    joined = cut.join(chained, (F.col("k") == F.col("k2")) & (F.col("stretch") == F.col("s2")))
    fired = joined.select("k", "stretch", "t", "id", "start").groupBy("k", "stretch").applyInPandas(replay, out)
    time = F.timestamp_micros("t").cast(dict(df.dtypes)[ts])
    return short.unionByName(fired).select(F.col("k").alias(key), time.alias(ts), F.col("id").alias(row_id))
