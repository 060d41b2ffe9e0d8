"""Cooldown in event-time order against the batch operator, from files in any order."""

import datetime as dt
import random

import pytest

from flowquarry.operators.cooldown import cooldown
from flowquarry.streaming import ordered as O
from flowquarry.streaming import streams as X

START = dt.datetime(2024, 1, 1)


def run(spark, folder, tmp_path, span, late):
    stream = X.read_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=1)
    found = O.ordered_cooldown(stream, "k", "ts", "id", span, late)
    out = str(tmp_path / "out")
    with O.with_ordered_state(spark):
        X.finish(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    return sorted((r.k, r.id, r.ts) for r in spark.read.parquet(out).collect())


def write(spark, folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, id long, ts timestamp_ntz").coalesce(1)
        df.write.parquet(str(folder / f"part={i:03d}"))


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_give_the_batch_answer(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abb") if i % 9 else None, i, START + dt.timedelta(seconds=rng.randrange(6 * 3600))) for i in range(500)]
    rows += [(k, 1000 + i, t) for i, (k, _, t) in enumerate(rows[:30])]  # equal times
    # Every row comes at most 50 minutes after its time.
    arrival = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(50)))
    batches = [arrival[i : i + 70] for i in range(0, len(arrival), 70)]
    folder = tmp_path / "in"
    write(spark, folder, batches)
    got = run(spark, folder, tmp_path, 600, "1 hour")
    known = spark.createDataFrame([r for r in rows if r[0]], "k string, id long, ts timestamp_ntz")
    edge = max(r[2] for r in rows) - dt.timedelta(hours=1)
    want = sorted((r.k, r.id, r.ts) for r in cooldown(known, "k", "ts", "id", "600 seconds").collect() if r.ts < edge)
    assert got == want and len({t for _, _, t in got}) > 20


def test_state_of_idle_keys_goes(spark, tmp_path):
    """A key fires again after its state was let go; only rows beyond the lateness are lost."""
    hour = dt.timedelta(hours=1)
    batches = [[("a", 1, START)], [("b", 2, START + 5 * hour)], [("a", 3, START + 6 * hour)], [("a", 4, START + hour), ("b", 5, START + 20 * hour)], [("b", 6, START + 30 * hour)]]
    folder = tmp_path / "in"
    write(spark, folder, batches)
    got = run(spark, folder, tmp_path, 600, "1 hour")
    assert [(k, i) for k, i, _ in got] == [("a", 1), ("a", 3), ("b", 2), ("b", 5)]
