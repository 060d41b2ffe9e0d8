"""Every micro-batch is recorded, also those a query's own progress has forgotten."""

from flowquarry.streaming import latency
from flowquarry.streaming import streams as X


def test_every_batch_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(latency, "HELD", 2)  # written out while the query runs
    folder = tmp_path / "in"
    for i in range(5):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(str(folder / f"p={i}"))
    stream = X.read_stream(spark, str(folder), spark.range(1).schema, max_files=1)
    with latency.recorded(spark, str(tmp_path / "latency")) as record:
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        X.finish(sink.trigger(availableNow=True).start())
    rows = sorted(record.table().collect(), key=lambda r: r.batch)
    assert [r.batch for r in rows] == list(range(5)) and [r.rows for r in rows] == [10] * 5
    assert all(r.ms > 0 and r.rows_per_second > 0 for r in rows) and len({r.query for r in rows}) == 1
