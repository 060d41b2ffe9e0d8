"""Files in and out, streams in several micro-batches, cooldown with hot keys."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from flowquarry.operators import alerts as A
from flowquarry.operators.cooldown import cooldown
from flowquarry.session import shared_dir
from flowquarry.sources import artifacts, sinks
from flowquarry.sources import flows as flow_files
from flowquarry.streaming import streams as X

START = dt.datetime(2024, 1, 1)


def _fold(pdf, span):
    fired = []
    for _, part in pdf.sort_values(["t", "id"]).groupby("key"):
        ready = -(2**62)
        for t, i in zip(part["t"], part["id"]):
            if t >= ready:
                fired.append(i)
                ready = t + span
    return sorted(fired)


@pytest.mark.parametrize("span,per_stretch", [(10, 25), (500, 40), (3, 1_000_000)])
def test_cooldown_matches_the_fold(spark, span, per_stretch, monkeypatch):
    from flowquarry.operators import cooldown as module

    monkeypatch.setattr(module, "MOST_ROWS_PER_STRETCH", 100)
    rng = np.random.default_rng(1)
    n = 2_000
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 30, n)), "t": rng.integers(0, 3_000, n), "id": rng.permutation(n)})
    df = spark.createDataFrame(pdf).select("key", F.timestamp_seconds("t").alias("ts"), "id")
    got = cooldown(df, "key", "ts", "id", f"{span} seconds", per_stretch)
    assert sorted(r["id"] for r in got.collect()) == _fold(pdf, span)


def test_cooldown_edge_is_inclusive(spark):
    df = spark.createDataFrame([(1, START, 1), (1, START + dt.timedelta(minutes=60), 2), (1, START + dt.timedelta(minutes=119), 3)], "key int, ts timestamp_ntz, id int")
    assert sorted(r["id"] for r in cooldown(df, "key", "ts", "id", "60 minutes").collect()) == [1, 2]


def _write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_cooldown_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "user long, ts timestamp, id long"
    at = lambda m: START + dt.timedelta(minutes=m)
    folder = str(tmp_path / "in")
    _write_batches(spark, folder, [[(1, at(0), 1), (1, at(30), 2)], [(1, at(59), 3), (2, at(59), 4)], [(1, at(60), 5), (2, at(130), 6)]], schema)
    fired = X.cooldown_stream(_stream(spark, folder, schema), "user", "ts", "id", 3600)
    q = X.finish(sinks.stream_to_files(fired, str(tmp_path / "out"), str(tmp_path / "log")))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4, 5, 6]
    # The stream ran in several micro-batches, whose rates are reported.
    rates = X.throughput(q)
    assert sum(r["rows"] for r in rates) == 6 and all(r["rows_per_second"] >= 0 for r in rates)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp"
    folder = str(tmp_path / "in")
    hour = lambda h: (START + dt.timedelta(hours=h),)
    _write_batches(spark, folder, [[hour(0), hour(10)], [hour(20)], [hour(0.1), hour(30)], [hour(40)]], schema)
    counts = X.tumbling_rate(_stream(spark, folder, schema), "ts", "1 hour", "1 hour")
    X.finish(sinks.stream_to_files(counts, str(tmp_path / "out"), str(tmp_path / "log")))
    got = {r["start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Spark judges lateness by the watermark a batch started from, so the late row comes
    # two batches after the one that moved it.
    assert got[START] == 1 and got[START + dt.timedelta(hours=10)] == 1


def test_device_state_over_batches(spark, tmp_path):
    schema = "device long, ts timestamp, id long, status string"
    folder = str(tmp_path / "in")
    at = lambda m: START + dt.timedelta(minutes=m)
    _write_batches(spark, folder, [[(1, at(5), 1, "ATTACK"), (2, at(1), 2, "SAFE")], [(1, at(3), 3, "SAFE"), (2, at(9), 4, "ATTACK")]], schema)
    X.finish(X.write_state(X.device_state(_stream(spark, folder, schema), "device", "ts", ["status"], "id"), str(tmp_path / "out"), str(tmp_path / "log")))
    assert {r["device"]: r["status"] for r in X.read_state(spark, str(tmp_path / "out"), "device").collect()} == {1: "ATTACK", 2: "ATTACK"}


def _csv(path, rows, header="Rate,Tot size"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(header + "\n" + "\n".join(rows) + "\n")


def test_flow_scan(spark, tmp_path):
    _csv(tmp_path / "train" / "deep" / "MQTT-DDoS-Connect_Flood_train.pcap.csv", ["Infinity,1", "abc,2", ",3"])
    _csv(tmp_path / "test" / "Benign_test.pcap.csv", ["2.5,4"])
    (tmp_path / "test" / "notes.txt").write_text("x\n")
    schema = flow_files.flow_schema(["Rate", "Tot size"], text=["Rate"])
    df = flow_files.with_labels(flow_files.scan_flows(spark, str(tmp_path), schema), legacy=False)
    rows = df.collect()
    assert len(rows) == 4 and {(r["Label"], r["SubType"]) for r in rows} == {("DDoS", "Connect_Flood"), ("Benign", "Benign")}
    assert all(r["source_file"].startswith("file:") and r["source_file"].endswith(r["basename"]) for r in rows)
    assert flow_files.scan_flows(spark, str(tmp_path), schema, name_contains="BENIGN").count() == 1
    splits = flow_files.scan_splits(spark, str(tmp_path / "train"), str(tmp_path / "test"), schema)
    assert {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()} == {"train": 3, "test": 1}
    (tmp_path / "nothing").mkdir()
    assert flow_files.scan_flows(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(AnalysisException):
        flow_files.scan_flows(spark, str(tmp_path / "missing"))
    inferred = flow_files.infer_schema(spark, str(tmp_path / "test"), 1.0)
    assert [f.dataType.simpleString() for f in inferred] == ["double", "int"]


def test_artifacts(spark, tmp_path):
    entry = {"min": [0.0, 1.0], "max": [2.0, 3.0], "mean": [1.0, 2.0], "std": [0.5, 0.5], "count": 7}
    (tmp_path / "p.json").write_text(json.dumps({"Benign": entry, "DDoS": entry}, indent=1))
    rows = artifacts.read_profiles(spark, str(tmp_path / "p.json"), ["a", "b"]).collect()
    assert len(rows) == 4 and {(r["feature"], r["mean"], r["count"]) for r in rows} == {("a", 1.0, 7), ("b", 2.0, 7)}
    (tmp_path / "c.json").write_text(json.dumps({"Benign": {"mean": [1.0], "median": [2.0], "count": 3}}))
    assert artifacts.read_prototypes(spark, str(tmp_path / "c.json"), ["a"]).first()["median"] == 2.0
    (tmp_path / "i.json").write_text(json.dumps({"x": 0.5, "y": 0.2, "z": 0.2}))
    assert [(r["feature"], r["position"]) for r in artifacts.read_importance(spark, str(tmp_path / "i.json")).collect()] == [("x", 1), ("y", 2), ("z", 3)]
    (tmp_path / "d.json").write_text(json.dumps({"x": "Speed"}))
    assert artifacts.read_descriptions(spark, str(tmp_path / "d.json")).first()["description"] == "Speed"
    assert artifacts.read_descriptions(spark, str(tmp_path / "none.json")).count() == 0


def test_alert_edges(spark):
    devices = spark.createDataFrame([(1, "pump", "10.0.0.1", 7)], "id long, name string, ip_address string, hospital_id long")
    schema = "alert_id long, device_ip string, dst_ip string, device_id long, hospital_id long, is_attack boolean, attack_type string, probability double"
    alerts = spark.createDataFrame(
        [
            (1, "10.0.0.1", None, None, None, True, "DDoS", 0.9),
            (2, None, "10.0.0.1", None, None, True, "DoS", 0.9),
            (3, "10.9.9.9", "10.0.0.1", None, None, True, "DoS", 0.9),
            (4, None, None, 5, 8, True, None, 0.5),
            (5, "10.0.0.1", None, None, None, False, "Benign", 0.9),
        ],
        schema,
    )
    enriched = A.enrich(alerts, devices)
    assert {r["alert_id"]: r["hospital_id"] for r in enriched.collect()} == {1: 7, 2: 7, 3: None, 4: 8, 5: 7}
    lines = {r["alert_id"]: r["description"] for r in A.log_lines(enriched).collect()}
    assert set(lines) == {1, 2, 4} and lines[4] == "Device 5 üzerinde Saldırı tespit edildi! (Güven: 0.50)"


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_columns_are_found_by_name(spark, tmp_path):
    files = {"a b.csv": "a,b\n1,2\n", "b.csv": "b,a\n20,10\n", "c.csv": "a, zzz ,b \n100,7,200\n", "d.csv": "b\n5\nx\n", "e.csv": "other\n9\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = flow_files.scan_flows(spark, str(tmp_path), flow_files.flow_schema(["a", "b"])).collect()
    got = sorted(((r["basename"], r["a"], r["b"]) for r in rows), key=repr)
    want = [("a b.csv", 1, 2), ("b.csv", 10, 20), ("c.csv", 100, 200), ("d.csv", None, 5), ("d.csv", None, None), ("e.csv", None, None)]
    assert [(n.replace("%20", " "), a, b) for n, a, b in got] == sorted(want, key=lambda r: repr((r[0], r[1] and float(r[1]), r[2] and float(r[2]))))


def test_headers_are_read_without_the_data(spark, tmp_path):
    import gzip

    folder = tmp_path / "a b%20c"
    folder.mkdir()
    (folder / "crlf.csv").write_bytes(b"\r\n\r\na,b\r\n1,2\r\n")
    (folder / "cr.csv").write_bytes(b"b,a\r3,4\r")
    (folder / "other.csv").write_text("x,y\n1,2\na,b\n")
    (folder / "empty.csv").write_text("")
    (folder / "alone.csv").write_text("a,b")
    long = "a," + "z" * 200_000 + ",b"
    (folder / "long.csv").write_text(long + "\n1,2,3\n")
    with gzip.open(folder / "packed.csv.gz", "wt") as f:
        f.write("b,a\n1,2\n")
    want = {"crlf.csv": "a,b", "cr.csv": "b,a", "other.csv": None, "alone.csv": "a,b", "long.csv": long, "packed.csv.gz": "b,a"}
    found = flow_files.file_headers(spark, str(tmp_path), ["a", "b"], "*.csv*")
    assert {p.rsplit("/", 1)[-1]: h for p, h in found} == want
    rows = flow_files.scan_flows(spark, str(tmp_path), flow_files.flow_schema(["a", "b"]), name_contains="crlf").collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 2.0)]


def test_headers_in_a_store_only_spark_opens(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two.csv").write_text("\nb,a\n1,2\n")
    spark.conf.set("fs.viewfs.mounttable.captures.link./data", f"file://{tmp_path}")
    try:
        found = flow_files.file_headers(spark, "viewfs://captures/data", ["a", "b"])
        assert {p.rsplit("/", 1)[-1]: h for p, h in found} == {"one.csv": "a,b", "two.csv": "b,a"}
        rows = flow_files.scan_flows(spark, "viewfs://captures/data", flow_files.flow_schema(["a", "b"])).collect()
        assert sorted((r.a, r.b) for r in rows) == [(1.0, 2.0), (2.0, 1.0)]
    finally:
        spark.conf.unset("fs.viewfs.mounttable.captures.link./data")
