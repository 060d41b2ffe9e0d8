"""Queries that run a stream over a given table to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions.numeric import round6
from flowquarry.operators import alerts as A
from flowquarry.operators import profiles as P
from flowquarry.plans.profiling import SCORED, SCORED_SQL
from flowquarry.plans.registry import ORACLE, query
from flowquarry.plans.relations import ALERTS_SQL, alert_stream
from flowquarry.session import fresh_path
from flowquarry.sources import flows as flow_files
from flowquarry.sources import sinks
from flowquarry.sources import tables as S
from flowquarry.streaming import latency, ordered
from flowquarry.streaming import streams as X


class _Streaming:
    """Gives the stand-in views a streaming scan of the table they are built on."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def flows(self):
        return S.flows_from(X.stream_table(self.spark, self.sf_dir, "lineitem"))

    def packets(self):
        return S.packets_from(X.stream_table(self.spark, self.sf_dir, "events"))


def _run(spark, stream, name):
    """Append the whole stream to files in the shared folder and read them back."""
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    X.finish(sinks.stream_to_files(stream, path, checkpoint))
    return spark.read.schema(stream.schema).parquet(path)


@query(f"WITH {S.FLOWS_SQL} SELECT capture, count(*) AS n, round(sum(\"Tot size\"), 2) AS total FROM flows GROUP BY capture")
def scan_flows(spark, sf_dir):
    """Write the flows as CSV, one folder per capture, and scan them with lineage."""
    root = fresh_path(spark, "flows-csv")
    columns = ["capture", *S.FEATURES]
    S.flows(spark, sf_dir).select(*[F.col(f"`{c}`") for c in columns]).write.partitionBy("capture").option("header", True).csv(root)
    df = flow_files.scan_flows(spark, root, flow_files.flow_schema(S.FEATURES))
    capture = F.regexp_extract("source_file", r"capture=([^/]+)/", 1)
    return df.groupBy(capture.alias("capture")).agg(F.count("*").alias("n"), F.round(F.sum("`Tot size`"), 2).alias("total"))


@query(f"WITH {ALERTS_SQL} SELECT alert_id, attack_type, probability, device_ip FROM alerts WHERE is_attack")
def alert_sink(spark, sf_dir):
    """Nested alerts as JSON and back."""
    path = fresh_path(spark, "alerts-json")
    attacks = alert_stream(S.packets(spark, sf_dir)).filter("is_attack")
    nested = attacks.select(
        "alert_id", "device_ip", "attack_type", F.struct(F.lit(True).alias("is_attack"), "probability").alias("prediction")
    )
    sinks.write_alerts(nested, path)
    schema = "alert_id bigint, device_ip string, attack_type string, prediction struct<is_attack: boolean, probability: double>"
    back = spark.read.schema(schema).json(path)
    return back.select("alert_id", "attack_type", F.col("prediction.probability").alias("probability"), "device_ip")


@query(f"WITH {SCORED_SQL} SELECT flow_id, predicted, round(confidence, 6) + 0.0 AS confidence FROM scored")
def stream_score(spark, sf_dir):
    model = P.fit_prototypes(S.flows(spark, sf_dir), SCORED)
    scored = model.transform(_Streaming(spark, sf_dir).flows())
    return _run(spark, scored.select("flow_id", "predicted", round6(F.col("confidence")).alias("confidence")), "scores")


@query(f"WITH {S.PACKETS_SQL} SELECT packet_id, device_id, predicted, confidence FROM packets WHERE predicted <> 'Benign' AND confidence >= 0.6")
def stream_alerts(spark, sf_dir):
    gated = A.gate_by_confidence(_Streaming(spark, sf_dir).packets())
    alerts = gated.filter(A.is_alert(F.col("final_label"), F.col("confidence")))
    return _run(spark, alerts.select("packet_id", "device_id", "predicted", "confidence"), "alerts")


@query(f"WITH {ALERTS_SQL} SELECT alert_id, is_attack::int AS is_attack, device_id, device_name, hospital_id FROM enriched")
def stream_enrich(spark, sf_dir):
    enriched = A.enrich(alert_stream(_Streaming(spark, sf_dir).packets()), S.devices(spark, sf_dir))
    rows = enriched.select("alert_id", F.col("is_attack").cast("int").alias("is_attack"), "device_id", "device_name", "hospital_id")
    return _run(spark, rows, "enriched")


@query(ORACLE["alert_log"])
def stream_alert_log(spark, sf_dir):
    enriched = A.enrich(alert_stream(_Streaming(spark, sf_dir).packets()), S.devices(spark, sf_dir))
    return _run(spark, A.log_lines(enriched), "log-lines")


@query(f"""WITH {S.PACKETS_SQL} SELECT device_id, CASE WHEN predicted <> 'Benign' AND confidence > 0.5 THEN 'ATTACK' ELSE 'SAFE' END AS status, ts
  FROM packets QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, packet_id DESC) = 1""")
def stream_device_state(spark, sf_dir):
    alert = A.is_alert(F.col("predicted"), F.col("confidence"))
    packets = _Streaming(spark, sf_dir).packets().select(
        "device_id", "ts", "packet_id", F.when(alert, "ATTACK").otherwise("SAFE").alias("status")
    )
    path, checkpoint = fresh_path(spark, "device-state"), fresh_path(spark, "device-state-log")
    X.finish(X.write_state(X.device_state(packets, "device_id", "ts", ["status"], "packet_id"), path, checkpoint))
    return X.read_state(spark, path, "device_id")


# In append mode a window comes out once the watermark, the last event time less the
# allowed lateness, has reached its end; the oracles keep the same windows.


@query(f"""WITH s AS (SELECT ts, time_bucket(INTERVAL 2 SECOND, ts) AS b FROM events),
  e AS (SELECT b - to_seconds(2 * k) AS start, ts FROM s, (SELECT unnest([0, 1, 2]) AS k) WHERE b - to_seconds(2 * k) + INTERVAL 5 SECOND > ts)
  SELECT start, count(*) AS n, CASE WHEN count(*) > 10 THEN 'high' ELSE 'normal' END AS status FROM e
  WHERE start + INTERVAL 5 SECOND <= (SELECT max(ts) - INTERVAL 60 SECOND FROM events) GROUP BY start""")
def stream_rate(spark, sf_dir):
    rates = X.sliding_rate(X.stream_table(spark, sf_dir, "events").select("ts"), "ts")
    return _run(spark, rates.withColumn("start", F.col("start").cast("timestamp_ntz")), "rates")


@query("""SELECT event_type, start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM events) e
  WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 60 MINUTE FROM events) GROUP BY event_type, start""")
def stream_tumbling(spark, sf_dir):
    rates = X.tumbling_rate(X.stream_table(spark, sf_dir, "events").select("event_type", "ts"), "ts", "6 hours", "60 minutes", ("event_type",))
    return _run(spark, rates.withColumn("start", F.col("start").cast("timestamp_ntz")), "tumbling")


@query(ORACLE["alert_cooldown"])
def stream_cooldown(spark, sf_dir):
    rows = X.stream_table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    fired = X.cooldown_stream(rows, "user_id", "ts", "event_id", 3 * 86400)
    return _run(spark, fired.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "cooldown")


@query(f"""SELECT * FROM ({ORACLE["alert_cooldown"]}) WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_cooldown_ordered(spark, sf_dir):
    """The batch answer up to the watermark, whatever order rows arrive in."""
    rows = X.stream_table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    fired = ordered.ordered_cooldown(rows, "user_id", "ts", "event_id", 3 * 86400)
    with ordered.with_ordered_state(spark):
        return _run(spark, fired.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "cooldown-ordered")


@query()
def batch_latency(spark, sf_dir):
    """Rows, milliseconds and rows per second of every micro-batch that scores the flows."""
    path, checkpoint = fresh_path(spark, "latency-scores"), fresh_path(spark, "latency-state")
    model = P.fit_prototypes(S.flows(spark, sf_dir), SCORED)
    scored = model.transform(_Streaming(spark, sf_dir).flows()).select("flow_id", "predicted")
    with latency.recorded(spark, fresh_path(spark, "latency")) as record:
        X.finish(sinks.stream_to_files(scored, path, checkpoint))
    return record.table()
