"""Queries over order: splits, windows, ranking, samples, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions.hashing import hash_word_sql
from flowquarry.operators import splits as P
from flowquarry.operators import windows as W
from flowquarry.operators.positions import top_per_group
from flowquarry.plans.registry import query
from flowquarry.sources import tables as S

H1, H2 = hash_word_sql("flow_id", 0), hash_word_sql("flow_id", 1)

ATTACKS = ["DDoS", "DoS", "MQTT", "Recon", "Spoofing"]


def _split_sql(order: str, first: float, second: float) -> str:
    return f"""WITH {S.FLOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM flows)
  SELECT flow_id, label, CASE WHEN rn <= floor(n * {first}::double) THEN 'train' WHEN rn <= floor(n * {second}::double) THEN 'val' ELSE 'test' END AS split FROM r"""


@query(_split_sql(f"ts, {H1}, {H2}", 0.70, 0.85))
def stratified_time_split(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    order = [W.micros(F.col("ts")), *S.flow_words()]
    return P.stratified_split(df, "label", order, {"train": 0.70, "val": 0.15, "test": 0.15}).select("flow_id", "label", "split")


@query(_split_sql(f"{H1}, {H2}", 0.70, 0.85))
def stratified_split(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    return P.stratified_split(df, "label", S.flow_words(), {"train": 0.70, "val": 0.15, "test": 0.15}).select("flow_id", "label", "split")


@query(_split_sql(f"{H1}, {H2}", 0.60, 0.80))
def stratified_split_60(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    return P.stratified_split(df, "label", S.flow_words(), {"train": 0.60, "val": 0.20, "test": 0.20}).select("flow_id", "label", "split")


WINDOW_SQL = (
    S.PACKETS_SQL
    + """, w AS (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY ts, packet_id) - 1) // 10 AS window_no FROM packets),
full_w AS (SELECT device_id, window_no FROM w GROUP BY ALL HAVING count(*) = 10),
votes AS (SELECT device_id, window_no, truth, count(*) AS c, min((ts, packet_id)) AS seen FROM w GROUP BY ALL),
win AS (SELECT device_id, window_no, truth, row_number() OVER (PARTITION BY device_id, window_no ORDER BY c DESC, seen) AS r FROM votes)"""
)


@query(f"""WITH {WINDOW_SQL} SELECT w.device_id, w.window_no, max(win.truth) AS majority_label, string_agg(packet_id::varchar, ',' ORDER BY ts, packet_id) AS packet_ids,
  round(sum(rate), 4) AS rate_sum FROM w JOIN full_w USING (device_id, window_no) JOIN win ON win.device_id = w.device_id AND win.window_no = w.window_no AND win.r = 1
  GROUP BY w.device_id, w.window_no""")
def count_windows(spark, sf_dir):
    df = W.count_windows(S.packets(spark, sf_dir), ["device_id"], "ts", "packet_id", 10, "truth", ["packet_id", "rate"])
    return df.select(
        "device_id", "window_no", "majority_label", F.array_join(F.col("packet_id").cast("array<string>"), ",").alias("packet_ids"),
        F.round(F.aggregate("rate", F.lit(0.0), lambda a, x: a + x), 4).alias("rate_sum"),
    )


@query(f"""WITH {S.FLOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY {H1}, {H2}) AS rn, count(*) OVER (PARTITION BY capture) AS total FROM flows)
  SELECT capture, flow_id, (rn - 1) // 75 + 1 AS block_id FROM r WHERE (rn - 1) // 75 + 1 <= total // 75 OR total % 75 >= 10""")
def row_blocks(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    return W.row_blocks(df, ["capture"], *S.flow_words(), 75, 10).select("capture", "flow_id", "block_id")


@query(f"""WITH {S.PACKETS_SQL}, v AS (SELECT device_id, truth, count(*) AS n, min((ts, packet_id)) AS seen FROM packets GROUP BY ALL)
  SELECT device_id, truth AS majority_label, n FROM v QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY n DESC, seen) = 1""")
def majority_label(spark, sf_dir):
    return W.majority_per_key(S.packets(spark, sf_dir), "device_id", "truth", "ts", "packet_id")


@query(f"""WITH {S.PACKETS_SQL} SELECT device_id, CASE WHEN predicted <> 'Benign' AND confidence > 0.5 THEN 'ATTACK' ELSE 'SAFE' END AS status, confidence AS last_risk_score, packet_id
  FROM packets QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, packet_id DESC) = 1""")
def latest_status(spark, sf_dir):
    alert = (F.col("predicted") != "Benign") & (F.col("confidence") > 0.5)
    df = S.packets(spark, sf_dir).select(
        "device_id", "ts", "packet_id", F.when(alert, "ATTACK").otherwise("SAFE").alias("status"), F.col("confidence").alias("last_risk_score")
    )
    return W.latest(df, "device_id", ["status", "last_risk_score", "packet_id"], [F.col("ts"), F.col("packet_id")])


@query(f"""WITH {S.PACKETS_SQL} SELECT device_id, packet_id, ts, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, packet_id DESC)::int AS position
  FROM packets WHERE predicted <> 'Benign' QUALIFY position <= 10""")
def last_n_alerts(spark, sf_dir):
    alerts = S.packets(spark, sf_dir).filter("predicted <> 'Benign'")
    return top_per_group(alerts, ["device_id"], [F.col("ts").desc(), F.col("packet_id").desc()], 10).select("device_id", "packet_id", "ts", "position")


@query(f"WITH {S.LOGS_SQL} SELECT * FROM logs ORDER BY timestamp DESC, id DESC LIMIT 50")
def recent_logs(spark, sf_dir):
    return S.activity_logs(spark, sf_dir).orderBy(F.desc("timestamp"), F.desc("id")).limit(50)


@query(f"WITH {S.DEVICES_SQL} SELECT * FROM devices ORDER BY id LIMIT 100 OFFSET 100")
def page_devices(spark, sf_dir):
    return S.devices(spark, sf_dir).orderBy("id").offset(100).limit(100)


@query(f"WITH {S.FLOWS_SQL} SELECT flow_id, label FROM flows WHERE {H1} < floor(0.3::double * 4294967296)::bigint")
def hash_sample(spark, sf_dir):
    return P.hash_sample(S.flows(spark, sf_dir), "flow_id", 0.3).select("flow_id", "label")


@query(f"WITH {S.FLOWS_SQL} SELECT flow_id, label FROM flows ORDER BY {H1}, flow_id LIMIT 5000")
def hash_shuffle_head(spark, sf_dir):
    return P.shuffled_head(S.flows(spark, sf_dir), "flow_id", 5000).select("flow_id", "label")


@query(f"""WITH {S.FLOWS_SQL}, r AS (SELECT label, flow_id, row_number() OVER (PARTITION BY label ORDER BY {H1}, flow_id)::int AS position FROM flows)
  SELECT * FROM r WHERE position <= CASE WHEN label = 'Benign' THEN 10 ELSE 5 END""")
def sample_per_class(spark, sf_dir):
    return P.sample_per_class(S.flows(spark, sf_dir), "label", "flow_id", 10, 5).select("label", "flow_id", "position")


@query(f"""WITH {S.FLOWS_SQL}, r AS (SELECT label, flow_id, row_number() OVER (PARTITION BY label ORDER BY ts, flow_id)::int AS position, count(*) OVER (PARTITION BY label) AS n FROM flows)
  SELECT label, flow_id, position FROM r WHERE (label = 'Benign' AND position <= 100) OR (label <> 'Benign' AND n >= 20 AND position <= 20)""")
def prefix_per_class(spark, sf_dir):
    return P.first_per_class(S.flows(spark, sf_dir), "label", [F.col("ts"), F.col("flow_id")], 100, 20).select("label", "flow_id", "position")


@query(f"""WITH {S.FLOWS_SQL}, r AS (SELECT label, flow_id, row_number() OVER (PARTITION BY label ORDER BY {H1}, flow_id) AS p FROM flows),
  b AS (SELECT flow_id, label, CASE WHEN label = 'Benign' THEN 2 * ((p - 1) // 10) ELSE 2 * list_position(['DDoS', 'DoS', 'MQTT', 'Recon', 'Spoofing'], label) - 1 END::int AS burst,
    CASE WHEN label = 'Benign' THEN (p - 1) % 10 + 1 ELSE p END::int AS position FROM r WHERE p <= CASE WHEN label = 'Benign' THEN 60 ELSE 5 END)
  SELECT *, row_number() OVER (ORDER BY burst, position)::int AS place FROM b""")
def burst_order(spark, sf_dir):
    return P.burst_order(S.flows(spark, sf_dir), "label", "flow_id", ATTACKS).select("flow_id", "label", "burst", "position", "place")


@query(f"""WITH {S.FLOWS_SQL} SELECT 'train' AS split, flow_id, "Rate", "IAT" FROM flows WHERE l_linenumber <= 5 UNION ALL SELECT 'test', flow_id, "Rate", "IAT" FROM flows WHERE l_linenumber > 5""")
def union_sources(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    train = df.filter("l_linenumber <= 5").select(F.lit("train").alias("split"), "flow_id", "Rate", "IAT")
    test = df.filter("l_linenumber > 5").select("flow_id", "IAT", "Rate", F.lit("test").alias("split"))
    return train.unionByName(test)


@query(f"""WITH {S.FLOWS_SQL} SELECT flow_id, label, copy::int AS copy FROM flows, LATERAL (SELECT unnest(range(CASE WHEN label = 'Benign' THEN 21 ELSE 1 END)) AS copy)""")
def oversample_class(spark, sf_dir):
    return P.oversample(S.flows(spark, sf_dir), F.col("label") == "Benign", 20).select("flow_id", "label", "copy")


@query("""SELECT count(*) AS n, CASE WHEN count(*) > 10 THEN 'high' ELSE 'normal' END AS status FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND""")
def recent_rate(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events").select("ts")
    return W.recent_rate(ev, "ts", ev.agg(F.max("ts")).scalar())


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_rate(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events").select("event_type", "ts")
    return ev.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(
        "event_type", F.col("w.start").alias("start"), "n"
    )


@query("""WITH s AS (SELECT ts, time_bucket(INTERVAL 2 SECOND, ts) AS b FROM events),
  e AS (SELECT b - to_seconds(2 * k) AS start, ts FROM s, (SELECT unnest([0, 1, 2]) AS k) WHERE b - to_seconds(2 * k) + INTERVAL 5 SECOND > ts)
  SELECT start, count(*) AS n, CASE WHEN count(*) > 10 THEN 'high' ELSE 'normal' END AS status FROM e GROUP BY start""")
def sliding_rate(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events").select("ts")
    counts = ev.groupBy(F.window("ts", "5 seconds", "2 seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "n", W.rate_status(F.col("n")).alias("status"))
