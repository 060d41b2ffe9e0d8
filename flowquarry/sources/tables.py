"""Declared schemas, parquet / JDBC table scans, and the stand-in views that play the
flow, packet, device, site and user tables on the given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.hashing import hash_word

# The relational tables and their columns.
TABLE_SCHEMAS = {
    "hospitals": "id bigint, name string, unique_code string, owner_id bigint",
    "users": "id bigint, email string, role string, hospital_id bigint",
    "devices": "id bigint, name string, ip_address string, room_number string, status string, "
    "last_risk_score double, hospital_id bigint",
    "events": "id bigint, device_id bigint, type string, message string, timestamp timestamp, hospital_id bigint",
    "analyses": "id bigint, device_id bigint, prediction_score double, xai_data string",
    "activity_logs": "id bigint, title string, description string, log_type string, timestamp timestamp, "
    "hospital_id bigint",
}

# Allowed words of the enumerated columns.
ROLES = ["TECH_STAFF", "MANAGER", "ADMIN"]
DEVICE_STATES = ["SAFE", "ATTACK", "ISOLATED"]
EVENT_TYPES = ["CRITICAL_ALERT", "ISOLATION", "INFO"]


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet scan of one relational table under its declared schema."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, lo: int, hi: int, parts: int, **options: str) -> DataFrame:
    """The same table over JDBC, read in ``parts`` id ranges."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn="id", lowerBound=lo, upperBound=hi, numPartitions=parts)
        .options(**options)
        .load()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins -------------------------------------------------------------------

FEATURES = ["Rate", "Tot size", "IAT", "Variance", "Number"]

# Which class and capture-name stem each returnflag + linestatus pair plays.
_PLAYS = {
    "RO": ("Benign", "Benign"),
    "AF": ("DDoS", "TCP_IP-DDoS-UDP"),
    "AO": ("DoS", "TCP_IP-DoS-TCP"),
    "NF": ("MQTT", "MQTT-Malformed_Data"),
    "NO": ("Recon", "Recon-OS_Scan"),
    "RF": ("Spoofing", "ARP_Spoofing"),
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as flow records: unique flow_id, class label, capture name and features."""
    return flows_from(table(spark, sf_dir, "lineitem"))


def flows_from(li: DataFrame) -> DataFrame:
    kind, number = F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber")
    label, stem = F, F.when((kind == "NF") & (number < 3), "MQTT-DDoS-Connect_Flood")
    for pair, (name, prefix) in _PLAYS.items():
        label, stem = label.when(kind == pair, name), stem.when(kind == pair, prefix)
    port = F.when(kind == "AF", number.cast("string")).otherwise("")
    half = F.when(number > 5, "_test.pcap.csv").otherwise("_train.pcap.csv")
    return li.select(
        F.concat_ws(
            "-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")
        ).alias("flow_id"),
        label.alias("label"),
        F.col("l_suppkey").alias("device_id"),
        F.col("l_shipdate").alias("ts"),
        "l_linenumber",
        F.col("l_extendedprice").alias("Rate"),
        F.col("l_quantity").alias("Tot size"),
        (F.col("l_tax") + 0.0).alias("IAT"),
        (F.col("l_discount") + 0.0).alias("Variance"),
        number.cast("double").alias("Number"),
        F.concat(stem, port, half).alias("capture"),
    )


FLOWS_SQL = """flows AS (
  SELECT *, CASE label
      WHEN 'Benign' THEN 'Benign_' || half
      WHEN 'DDoS' THEN 'TCP_IP-DDoS-UDP' || l_linenumber || '_' || half
      WHEN 'DoS' THEN 'TCP_IP-DoS-TCP_' || half
      WHEN 'MQTT' THEN CASE WHEN l_linenumber < 3 THEN 'MQTT-DDoS-Connect_Flood_' ELSE 'MQTT-Malformed_Data_' END || half
      WHEN 'Recon' THEN 'Recon-OS_Scan_' || half
      ELSE 'ARP_Spoofing_' || half END || '.pcap.csv' AS capture
  FROM (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS flow_id,
      CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'Benign' WHEN 'AF' THEN 'DDoS' WHEN 'AO' THEN 'DoS'
        WHEN 'NF' THEN 'MQTT' WHEN 'NO' THEN 'Recon' WHEN 'RF' THEN 'Spoofing' END AS label,
      CASE WHEN l_linenumber > 5 THEN 'test' ELSE 'train' END AS half,
      l_suppkey AS device_id, l_shipdate AS ts, l_linenumber,
      l_extendedprice AS "Rate", l_quantity AS "Tot size", l_tax + 0.0::double AS "IAT",
      l_discount + 0.0::double AS "Variance", l_linenumber::double AS "Number"
    FROM lineitem))"""


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows whose Rate holds infinities, NaN and gaps, with a text twin of the column."""
    size, rate = F.col("`Tot size`"), F.col("Rate")
    return flows(spark, sf_dir).withColumns(
        {
            "Rate": F.when(size == 13, F.lit(float("inf")))
            .when(size == 26, F.lit(float("-inf")))
            .when(size == 39, F.lit(float("nan")))
            .when(size != 47, rate),
            "rate_text": F.when(size == 13, "Infinity")
            .when(size == 26, "-inf")
            .when(size == 39, "nan")
            .when(size == 47, "abc")
            .when(size == 48, "")
            .otherwise(rate.cast("string")),
        }
    )


DIRTY_SQL = (
    FLOWS_SQL
    + """, dirty AS (
  SELECT * EXCLUDE ("Rate"),
    CASE "Tot size" WHEN 13 THEN 'inf'::double WHEN 26 THEN '-inf'::double WHEN 39 THEN 'nan'::double
      WHEN 47 THEN NULL ELSE "Rate" END AS "Rate",
    CASE "Tot size" WHEN 13 THEN 'Infinity' WHEN 26 THEN '-inf' WHEN 39 THEN 'nan' WHEN 47 THEN 'abc'
      WHEN 48 THEN '' ELSE "Rate"::varchar END AS rate_text
  FROM flows)"""
)


def flow_words(key: str = "flow_id") -> tuple[Column, Column]:
    """Two 32-bit hash words: the random order of flows."""
    return hash_word(F.col(key), 0), hash_word(F.col(key), 1)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored packets: class, confidence, truth and device."""
    return packets_from(table(spark, sf_dir, "events"))


def packets_from(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("packet_id"),
        "ts",
        F.col("user_id").alias("device_id"),
        _event_class("event_type").alias("predicted"),
        _truth_class(k).alias("truth"),
        (k / 100.0).alias("confidence"),
        F.col("value").alias("rate"),
        "props",
    )


def _event_class(column: str) -> Column:
    c = F.col(column)
    return (
        F.when(c == "error", "DDoS").when(c == "signup", "DoS").when(c == "purchase", "Recon")
        .when(c == "view", "MQTT").otherwise("Benign")
    )


def _truth_class(k: Column) -> Column:
    return (
        F.when(k < 40, "Benign").when(k < 60, "DDoS").when(k < 75, "DoS").when(k < 90, "Recon").otherwise("MQTT")
    )


PACKETS_SQL = """packets AS (
  SELECT event_id AS packet_id, ts, user_id AS device_id,
    CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'signup' THEN 'DoS' WHEN 'purchase' THEN 'Recon'
      WHEN 'view' THEN 'MQTT' ELSE 'Benign' END AS predicted,
    CASE WHEN k < 40 THEN 'Benign' WHEN k < 60 THEN 'DDoS' WHEN k < 75 THEN 'DoS' WHEN k < 90 THEN 'Recon'
      ELSE 'MQTT' END AS truth,
    k / 100.0::double AS confidence, value AS rate, props
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events))"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as devices; every device gets an address and belongs to a site."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat_ws(
            ".", F.lit("10"), F.floor(key / 65536) % 256, F.floor(key / 256) % 256, key % 256
        ).alias("ip_address"),
        F.when(F.col("c_acctbal") < 0, "ATTACK").when(F.col("c_acctbal") > 9500, "ISOLATED").otherwise("SAFE")
        .alias("status"),
        F.lit(0.0).alias("last_risk_score"),
        F.col("c_nationkey").cast("bigint").alias("hospital_id"),
    )


DEVICES_SQL = """devices AS (
  SELECT c_custkey AS id, c_name AS name,
    '10.' || (c_custkey // 65536) % 256 || '.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 AS ip_address,
    CASE WHEN c_acctbal < 0 THEN 'ATTACK' WHEN c_acctbal > 9500 THEN 'ISOLATED' ELSE 'SAFE' END AS status,
    0.0::double AS last_risk_score, c_nationkey::bigint AS hospital_id
  FROM customer)"""


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as sites, owned by the user whose id is the region key."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("CODE-"), F.col("n_nationkey")).alias("unique_code"),
        F.col("n_regionkey").cast("bigint").alias("owner_id"),
    )


HOSPITALS_SQL = """hospitals AS (
  SELECT n_nationkey::bigint AS id, n_name AS name, 'CODE-' || n_nationkey AS unique_code,
    n_regionkey::bigint AS owner_id FROM nation)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as users: the richest are admins, the poorest have no site."""
    s = table(spark, sf_dir, "supplier")
    balance = F.col("s_acctbal")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@example.org")).alias("email"),
        F.when((balance > 9000) | (F.col("s_suppkey") < 5), "ADMIN").when(balance > 5000, "MANAGER")
        .otherwise("TECH_STAFF").alias("role"),
        F.when((balance > 1000) & (balance <= 9500), F.col("s_nationkey").cast("bigint")).alias("hospital_id"),
    )


USERS_SQL = """users AS (
  SELECT s_suppkey AS id, lower(replace(s_name, '#', '.')) || '@example.org' AS email,
    CASE WHEN s_acctbal > 9000 OR s_suppkey < 5 THEN 'ADMIN' WHEN s_acctbal > 5000 THEN 'MANAGER'
      ELSE 'TECH_STAFF' END AS role,
    CASE WHEN s_acctbal > 1000 AND s_acctbal <= 9500 THEN s_nationkey::bigint END AS hospital_id
  FROM supplier)"""


def activity_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines; signups are system lines without a site."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("id"),
        kind.alias("title"),
        F.when(kind == "error", "DANGER").when(kind == "purchase", "SUCCESS").when(kind == "view", "WARNING")
        .otherwise("INFO").alias("log_type"),
        F.col("ts").alias("timestamp"),
        F.when(kind != "signup", F.col("user_id") % 25).alias("hospital_id"),
    )


LOGS_SQL = """logs AS (
  SELECT event_id AS id, event_type AS title,
    CASE event_type WHEN 'error' THEN 'DANGER' WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'WARNING'
      ELSE 'INFO' END AS log_type,
    ts AS "timestamp", CASE WHEN event_type <> 'signup' THEN user_id % 25 END AS hospital_id
  FROM events)"""

