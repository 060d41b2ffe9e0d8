"""Queries over scans, labelling, cleaning and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions import labels as L
from flowquarry.functions import numeric as N
from flowquarry.functions.features import FLOW_FEATURES, interaction_features as add_interactions, log1p_skewed as add_logs, quoted
from flowquarry.operators import cleaning as C
from flowquarry.operators.alerts import alert_record, gate_by_confidence, message_for
from flowquarry.operators.positions import top_per_group
from flowquarry.plans.registry import query
from flowquarry.sources import tables as S
from flowquarry.functions.numeric import round6

KEYWORD_SQL = """CASE WHEN contains(lower({c}), 'benign') THEN 'Benign' WHEN contains(lower({c}), 'ddos') THEN 'DDoS'
  WHEN contains(lower({c}), 'dos') THEN 'DoS' WHEN contains(lower({c}), 'mqtt') THEN 'MQTT'
  WHEN contains(lower({c}), 'recon') THEN 'Recon' WHEN contains(lower({c}), 'spoof') THEN 'Spoofing' ELSE 'Unknown' END"""

PARSED_SQL = (
    S.FLOWS_SQL
    + """, parsed AS (SELECT *, CASE protocol WHEN 'MQTT' THEN regexp_extract(basename, '^MQTT-([^-]+)-', 1)
      WHEN 'TCP_IP' THEN regexp_extract(basename, '^TCP_IP-([^-]+)-', 1) WHEN 'Recon' THEN 'Recon'
      WHEN 'ARP' THEN 'Spoofing' WHEN 'Benign' THEN 'Benign' ELSE 'Unknown' END AS raw_label,
    CASE protocol WHEN 'MQTT' THEN regexp_extract(basename, '^MQTT-[^-]+-([^_]+)_', 1)
      WHEN 'TCP_IP' THEN regexp_extract(basename, '^TCP_IP-[^-]+-([^_]+)_', 1)
      WHEN 'Recon' THEN regexp_extract(basename, '^Recon-([^_]+)_', 1)
      WHEN 'ARP' THEN 'ARP_Spoofing' WHEN 'Benign' THEN 'Benign' ELSE 'Unknown' END AS subtype_legacy,
    CASE protocol WHEN 'MQTT' THEN regexp_extract(basename, '^MQTT-[^-]+-(.+)_(?:train|test)', 1)
      WHEN 'TCP_IP' THEN regexp_extract(basename, '^TCP_IP-[^-]+-(.+)_(?:train|test)', 1)
      WHEN 'Recon' THEN regexp_extract(basename, '^Recon-(.+)_(?:train|test)', 1)
      WHEN 'ARP' THEN 'ARP_Spoofing' WHEN 'Benign' THEN 'Benign' ELSE 'Unknown' END AS subtype
  FROM (SELECT *, CASE WHEN starts_with(basename, 'MQTT-') THEN 'MQTT' WHEN starts_with(basename, 'TCP_IP-') THEN 'TCP_IP'
      WHEN starts_with(basename, 'Recon-') THEN 'Recon' WHEN starts_with(basename, 'ARP_') THEN 'ARP'
      WHEN starts_with(basename, 'Benign') THEN 'Benign' ELSE 'Unknown' END AS protocol
    FROM (SELECT *, regexp_extract('file:/captures/' || capture, '([^/]+)$', 1) AS basename FROM flows)))"""
)


def parsed(spark, sf_dir):
    """flows with path, basename, protocol, label and subtype columns."""
    df = S.flows(spark, sf_dir).withColumn("basename", L.basename(F.concat(F.lit("file:/captures/"), F.col("capture"))))
    name = F.col("basename")
    return df.withColumns(
        {
            "protocol": L.protocol_of(name),
            "raw_label": L.label_of(name),
            "subtype_legacy": L.subtype_of(name),
            "subtype": L.subtype_of(name, legacy=False),
        }
    )


@query(f"WITH {PARSED_SQL} SELECT flow_id, basename, protocol, raw_label, subtype_legacy, subtype FROM parsed")
def parse_source_name(spark, sf_dir):
    return parsed(spark, sf_dir).select("flow_id", "basename", "protocol", "raw_label", "subtype_legacy", "subtype")


@query(f"WITH {PARSED_SQL} SELECT DISTINCT basename, protocol, raw_label, subtype FROM parsed")
def distinct_labels(spark, sf_dir):
    return parsed(spark, sf_dir).select("basename", "protocol", "raw_label", "subtype").distinct()


@query(f"""WITH {S.FLOWS_SQL} SELECT flow_id, keyword, CASE WHEN contains(lower(capture), 'benign') THEN 'BENIGN' ELSE 'ATTACK' END AS truth,
  (upper(keyword) NOT IN ('BENIGN', 'NORMAL', 'SAFE'))::int AS is_threat, (keyword <> 'Benign')::int AS target
  FROM (SELECT *, {KEYWORD_SQL.format(c="capture")} AS keyword FROM flows)""")
def keyword_label(spark, sf_dir):
    name = F.col("capture")
    keyword = L.keyword_class(name)
    return S.flows(spark, sf_dir).select(
        "flow_id",
        keyword.alias("keyword"),
        F.when(F.lower(name).contains("benign"), "BENIGN").otherwise("ATTACK").alias("truth"),
        L.label_is_threat(keyword).cast("int").alias("is_threat"),
        L.binary_target(keyword).alias("target"),
    )


@query(f"""WITH {S.FLOWS_SQL} SELECT keyword, count(DISTINCT capture) AS n_sources, count(*) AS n_rows,
  string_agg(DISTINCT capture, ',' ORDER BY capture) AS sources
  FROM (SELECT *, {KEYWORD_SQL.format(c="capture")} AS keyword FROM flows) GROUP BY keyword""")
def source_catalog(spark, sf_dir):
    # Names collapse to one row per source first, so a hot source sends one row per task.
    per_source = S.flows(spark, sf_dir).groupBy("capture").count()
    return (
        per_source.groupBy(L.keyword_class(F.col("capture")).alias("keyword"))
        .agg(
            F.count("*").alias("n_sources"),
            F.sum("count").alias("n_rows"),
            F.array_join(F.sort_array(F.collect_list("capture")), ",").alias("sources"),
        )
    )


@query(f"WITH {S.FLOWS_SQL} SELECT flow_id, capture FROM flows WHERE contains(lower(capture), 'benign')")
def sources_matching(spark, sf_dir):
    return S.flows(spark, sf_dir).filter(F.lower("capture").contains("benign")).select("flow_id", "capture")


@query(f"""WITH {S.FLOWS_SQL} SELECT capture, flow_id, position FROM (SELECT *,
  row_number() OVER (PARTITION BY capture ORDER BY ts, flow_id) AS position FROM flows) WHERE position <= 1000""")
def cap_per_source(spark, sf_dir):
    return top_per_group(S.flows(spark, sf_dir), ["capture"], [F.col("ts"), F.col("flow_id")], 1000).select(
        "capture", "flow_id", "position"
    )


@query(f"""WITH {S.FLOWS_SQL} SELECT capture, flow_id, position FROM (SELECT *,
  row_number() OVER (PARTITION BY capture ORDER BY ts, flow_id) AS position FROM flows)
  WHERE position <= 20000 // (SELECT count(DISTINCT capture) FROM flows)""")
def budget_per_source(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    sources = df.agg(F.count_distinct("capture")).collect()[0][0]
    cap = 20_000 // max(1, sources)
    return top_per_group(
        df, ["capture"], [F.col("ts"), F.col("flow_id")], cap, salt=F.col("flow_id")
    ).select("capture", "flow_id", "position")


@query(f"""WITH {S.FLOWS_SQL} SELECT 'flows' AS table_name, (SELECT count(*) FROM flows) AS n_rows, 6::bigint AS n_columns,
  (SELECT count(DISTINCT capture) FROM flows) AS n_sources, (SELECT count(DISTINCT label) FROM flows) AS n_labels,
  (SELECT count(*) FROM flows WHERE label = 'Benign') AS n_benign""")
def table_summary(spark, sf_dir):
    df = S.flows(spark, sf_dir).select("label", "capture", *map(quoted, ["Rate", "Tot size", "IAT", "Variance"]))
    # Two levels instead of an expanding multi-distinct: sources are few, rows are many.
    per_source = df.groupBy("label", "capture").agg(F.count("*").alias("n"))
    return per_source.agg(
        F.lit("flows").alias("table_name"),
        F.sum("n").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.count_distinct("capture").alias("n_sources"),
        F.count_distinct("label").alias("n_labels"),
        F.sum(F.when(F.col("label") == "Benign", F.col("n")).otherwise(0)).alias("n_benign"),
    )


@query(f"""WITH {S.FLOWS_SQL} SELECT label, "Rate", "Tot size", "IAT", "Variance" FROM flows""")
def drop_leakage(spark, sf_dir):
    df = S.flows(spark, sf_dir).select(
        F.col("flow_id").alias("Flow ID"), F.col("ts").alias("Timestamp"), F.col("capture").alias("basename"),
        F.col("device_id").alias("Src IP"), "label", *map(quoted, ["Rate", "Tot size", "IAT", "Variance"]),
    )
    return C.drop_leakage(df, "training")


_HELD = {"Rate", "Tot size", "IAT", "Variance", "Number"}
_REINDEX_SQL = ", ".join(f'"{c}"' if c in _HELD else f'0.0::double AS "{c}"' for c in FLOW_FEATURES)


@query(f"WITH {S.FLOWS_SQL} SELECT flow_id, {_REINDEX_SQL} FROM flows")
def reindex_features(spark, sf_dir):
    return C.reindex(S.flows(spark, sf_dir), FLOW_FEATURES, keep=["flow_id"])


@query(f"""WITH {S.FLOWS_SQL} SELECT 'train' AS split, flow_id, "Rate", (label = 'DDoS')::int::double AS is_ddos, "IAT" FROM flows WHERE l_linenumber <= 5
  UNION ALL SELECT 'test', flow_id, "Rate", 0.0::double, "IAT" FROM flows WHERE l_linenumber > 5""")
def align_splits(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    train = df.filter("l_linenumber <= 5").select(
        "flow_id", "Rate", (F.col("label") == "DDoS").cast("double").alias("is_ddos"), "IAT"
    )
    test = df.filter("l_linenumber > 5").select("flow_id", "IAT", F.col("Variance").alias("extra"), "Rate")
    train, test = C.align_splits(train, test, keep=["flow_id"])
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query(f"""WITH {S.DIRTY_SQL}, n AS (SELECT *, try_cast(rate_text AS double) AS v FROM dirty)
  SELECT flow_id, CASE WHEN v IS NULL THEN 'missing' WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN 'inf' ELSE 'number' END AS kind,
    CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0::double ELSE v END AS value FROM n""")
def to_numeric(spark, sf_dir):
    v = F.col("v")
    return (
        S.dirty_flows(spark, sf_dir)
        .select("flow_id", N.to_double(F.col("rate_text")).alias("v"))
        .select(
            "flow_id",
            F.when(v.isNull(), "missing").when(F.isnan(v), "nan").when(~N.is_finite(v), "inf").otherwise("number").alias("kind"),
            N.finite_or_zero(v).alias("value"),
        )
    )


@query(f"""WITH {S.DIRTY_SQL} SELECT flow_id, CASE WHEN NOT isnan("Rate") AND NOT isinf("Rate") THEN "Rate" END AS rate_or_null,
  CASE WHEN "Rate" IS NULL OR isnan("Rate") OR isinf("Rate") THEN 0.0::double ELSE "Rate" END AS rate_or_zero FROM dirty""")
def sanitize_inf(spark, sf_dir):
    return S.dirty_flows(spark, sf_dir).select(
        "flow_id",
        N.finite_or_null(F.col("Rate")).alias("rate_or_null"),
        N.finite_or_zero(F.col("Rate")).alias("rate_or_zero"),
    )


_CLEAN_SQL = f"""{S.DIRTY_SQL}, clean AS (SELECT flow_id, CASE WHEN NOT isnan("Rate") AND NOT isinf("Rate") THEN "Rate" END AS rate,
    CASE WHEN "Tot size" <> 47 THEN "Tot size" END AS size, CASE WHEN "Tot size" <> 26 THEN capture END AS capture FROM dirty)"""


def _gappy(spark, sf_dir):
    size = quoted("Tot size")
    return S.dirty_flows(spark, sf_dir).select(
        "flow_id",
        F.col("Rate").alias("rate"),
        F.when(size != 47, size).alias("size"),
        F.when(size != 26, F.col("capture")).alias("capture"),
    )


@query(f"""WITH {_CLEAN_SQL} SELECT flow_id, coalesce(rate, (SELECT quantile_disc(rate, 0.5) FROM clean)) AS rate,
  coalesce(size, (SELECT quantile_disc(size, 0.5) FROM clean)) AS size FROM clean""")
def impute_median(spark, sf_dir):
    return C.impute_median(_gappy(spark, sf_dir).drop("capture"), ["rate", "size"])


@query(f"""WITH {_CLEAN_SQL} SELECT flow_id,
  coalesce(rate, (SELECT rate FROM clean WHERE rate IS NOT NULL GROUP BY rate ORDER BY count(*) DESC, rate LIMIT 1)) AS rate,
  coalesce(size, (SELECT size FROM clean WHERE size IS NOT NULL GROUP BY size ORDER BY count(*) DESC, size LIMIT 1)) AS size,
  coalesce(capture, (SELECT capture FROM clean WHERE capture IS NOT NULL GROUP BY capture ORDER BY count(*) DESC, capture LIMIT 1)) AS capture
  FROM clean""")
def impute_mode(spark, sf_dir):
    return C.impute_mode(C.sanitize(_gappy(spark, sf_dir), ["rate", "size"]), ["rate", "size", "capture"])


_RAW_SQL = f"""{PARSED_SQL}, raw AS (SELECT flow_id, CASE WHEN "Tot size" = 47 THEN NULL WHEN "Tot size" = 26 THEN '0' ELSE raw_label END AS label FROM parsed)"""


def _raw_labels(spark, sf_dir):
    size = quoted("Tot size")
    return parsed(spark, sf_dir).select(
        "flow_id", F.when(size == 26, "0").when(size != 47, F.col("raw_label")).alias("label")
    )


@query(f"WITH {_RAW_SQL} SELECT flow_id, label FROM raw WHERE label IS NOT NULL AND label NOT IN ('', '0')")
def valid_labels(spark, sf_dir):
    return _raw_labels(spark, sf_dir).filter(L.is_valid_label(F.col("label")))


@query(f"""WITH {_RAW_SQL} SELECT flow_id, CASE WHEN label IS NULL OR trim(label) = '' THEN 'MQTT' ELSE label END AS label,
  (label IS NULL)::int AS was_null FROM raw""")
def fill_labels(spark, sf_dir):
    return _raw_labels(spark, sf_dir).select(
        "flow_id",
        L.fill_label(F.col("label")).alias("label"),
        F.col("label").isNull().cast("int").alias("was_null"),
    )


def _fin(expr: str) -> str:
    return f"(CASE WHEN ({expr}) IS NULL OR isnan({expr}) OR isinf({expr}) THEN 0.0::double ELSE round({expr}, 6) + 0.0 END)"


def _ln(expr: str) -> str:
    return f"(CASE WHEN {expr} > -1 THEN ln(1 + {expr}) END)"


@query(f"""WITH {S.DIRTY_SQL} SELECT flow_id, {_fin('"Rate" * "Variance"')} AS "Rate_Variance", {_fin('"Rate" * "IAT"')} AS "Rate_IAT",
  {_fin('"Tot size" / ("Rate" + 1e-5)')} AS "Size_Rate_Ratio", {_fin(_ln('"Rate"'))} AS "Log_Rate", {_fin(_ln('"Variance"'))} AS "Log_Variance",
  {_fin(_ln('"Tot size"'))} AS "Log_Tot_Size", {_fin(_ln('("Number" * "IAT")'))} AS "Log_Duration",
  {_fin('"Tot size" / ("Number" + 1)')} AS "Size_Per_Packet" FROM dirty""")
def interaction_features(spark, sf_dir):
    names = ["Rate_Variance", "Rate_IAT", "Size_Rate_Ratio", "Log_Rate", "Log_Variance", "Log_Tot_Size", "Log_Duration", "Size_Per_Packet"]
    df = add_interactions(S.dirty_flows(spark, sf_dir))
    return df.select("flow_id", *[round6(F.col(c)).alias(c) for c in names])


@query(f"""WITH {S.FLOWS_SQL} SELECT flow_id, round(ln(1 + "Rate"), 6) AS rate, round(ln(1 + "Variance"), 6) AS variance,
  round(ln(1 + "Tot size"), 6) AS size, round(ln(1 + "IAT"), 6) AS iat, round(ln(1 + "Number"), 6) AS number FROM flows""")
def log1p_skewed(spark, sf_dir):
    df = add_logs(S.flows(spark, sf_dir))
    names = {"Rate": "rate", "Variance": "variance", "Tot size": "size", "IAT": "iat", "Number": "number"}
    return df.select("flow_id", *[round6(quoted(c)).alias(a) for c, a in names.items()])


@query(f"""WITH {S.DIRTY_SQL}, c AS (SELECT flow_id, "Rate" AS r1, CASE WHEN "IAT" > 0 THEN "Tot size" / "IAT" END AS r2,
    CASE WHEN "Tot size" < 30 THEN "Tot size" END AS s1, "Number" AS s2, CASE WHEN l_linenumber > 3 THEN l_linenumber END AS p1 FROM dirty)
  SELECT flow_id, round(CASE WHEN NOT isnan(r1) AND NOT isinf(r1) THEN r1 ELSE coalesce(r2, 0) END, 6) AS rate,
    coalesce(s1, s2, 0) AS size, coalesce(p1, 0)::double AS protocol FROM c""")
def first_finite(spark, sf_dir):
    size, iat = quoted("Tot size"), quoted("IAT")
    df = S.dirty_flows(spark, sf_dir).select(
        "flow_id",
        F.col("Rate").alias("r1"),
        F.when(iat > 0, F.try_divide(size, iat)).alias("r2"),
        F.when(size < 30, size).alias("s1"),
        F.col("Number").alias("s2"),
        F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("double")).alias("p1"),
    )
    return df.select(
        "flow_id",
        round6(N.first_finite([F.col("r1"), F.col("r2")])).alias("rate"),
        N.first_finite([F.col("s1"), F.col("s2")]).alias("size"),
        F.coalesce("p1", F.lit(0.0)).alias("protocol"),
    )


@query(f"""WITH {S.PACKETS_SQL}, {S.DEVICES_SQL} SELECT p.packet_id, d.ip_address AS device_ip, (p.predicted <> 'Benign')::int AS is_attack,
  p.confidence AS probability, p.predicted AS label, p.predicted AS attack_type, strftime(p.ts, '%Y-%m-%dT%H:%M:%S') AS stamp, p.rate AS rate
  FROM packets p LEFT JOIN devices d ON d.id = p.device_id""")
def build_alert(spark, sf_dir):
    joined = S.packets(spark, sf_dir).join(
        S.devices(spark, sf_dir).select(F.col("id").alias("device_id"), "ip_address"), "device_id", "left"
    )
    alert = joined.select("packet_id", alert_record(joined).alias("a"))
    return alert.select(
        "packet_id",
        F.col("a.device_ip").alias("device_ip"),
        F.col("a.prediction.is_attack").cast("int").alias("is_attack"),
        F.col("a.prediction.probability").alias("probability"),
        F.col("a.prediction.label").alias("label"),
        F.col("a.attack_type").alias("attack_type"),
        F.col("a.timestamp").alias("stamp"),
        F.col("a.traffic_data.rate").alias("rate"),
    )


@query(f"""WITH {S.PACKETS_SQL}, p AS (SELECT packet_id, CASE WHEN predicted = 'MQTT' THEN confidence * 100 ELSE confidence END AS raw,
    CASE WHEN predicted = 'Recon' THEN NULL WHEN predicted = 'Benign' THEN ' benign ' ELSE lower(predicted) END AS status,
    CASE predicted WHEN 'DDoS' THEN 'ATTACK_LOG' WHEN 'DoS' THEN 'DANGER' WHEN 'MQTT' THEN 'WARNING' WHEN 'Recon' THEN 'SUCCESS' ELSE 'INFO' END AS log_type FROM packets)
  SELECT packet_id, round(prob, 6) AS probability, CASE WHEN prob > 0.8 THEN 'high' WHEN prob > 0.5 THEN 'medium' ELSE 'low' END AS band,
    (upper(trim(coalesce(status, 'SAFE'))) NOT IN ('SAFE', 'BENIGN'))::int AS under_attack,
    CASE log_type WHEN 'SUCCESS' THEN 'success' WHEN 'WARNING' THEN 'warning' WHEN 'DANGER' THEN 'danger' WHEN 'ATTACK_LOG' THEN 'danger' ELSE 'info' END AS severity
  FROM (SELECT *, CASE WHEN raw > 1 THEN raw / 100 ELSE raw END AS prob FROM p)""")
def risk_band(spark, sf_dir):
    kind = F.col("predicted")
    df = S.packets(spark, sf_dir).select(
        "packet_id",
        F.when(kind == "MQTT", F.col("confidence") * 100.0).otherwise(F.col("confidence")).alias("raw"),
        F.when(kind == "Benign", " benign ").when(kind != "Recon", F.lower(kind)).alias("status"),
        F.when(kind == "DDoS", "ATTACK_LOG").when(kind == "DoS", "DANGER").when(kind == "MQTT", "WARNING")
        .when(kind == "Recon", "SUCCESS").otherwise("INFO").alias("log_type"),
    )
    p = N.unit_probability(F.col("raw"))
    return df.select(
        "packet_id",
        round6(p).alias("probability"),
        N.risk_band(p).alias("band"),
        L.status_is_attack(F.col("status")).cast("int").alias("under_attack"),
        L.severity_of(F.col("log_type")).alias("severity"),
    )


@query(f"""WITH {S.PACKETS_SQL}, {S.DEVICES_SQL} SELECT p.packet_id, coalesce(d.name, 'Device ' || p.device_id) || ' üzerinde ' || p.predicted
  || ' tespit edildi! (Güven: ' || printf('%.2f', p.confidence) || ')' AS message
  FROM packets p LEFT JOIN devices d ON d.id = p.device_id AND d.status <> 'ISOLATED' WHERE p.predicted <> 'Benign'""")
def alert_message(spark, sf_dir):
    named = S.devices(spark, sf_dir).filter("status <> 'ISOLATED'").select(F.col("id").alias("device_id"), "name")
    attacks = S.packets(spark, sf_dir).filter("predicted <> 'Benign'").join(named, "device_id", "left")
    return attacks.select(
        "packet_id",
        message_for(F.col("name"), F.col("device_id"), F.col("predicted"), F.col("confidence")).alias("message"),
    )


@query(f"WITH {S.DEVICES_SQL} SELECT * FROM devices WHERE id = 42")
def lookup_device(spark, sf_dir):
    return S.devices(spark, sf_dir).filter("id = 42")


@query(f"WITH {S.DEVICES_SQL} SELECT * FROM devices WHERE hospital_id = 7 AND status = 'SAFE'")
def device_of_tenant(spark, sf_dir):
    return S.devices(spark, sf_dir).filter("hospital_id = 7 and status = 'SAFE'")


@query(f"""WITH {S.PACKETS_SQL} SELECT packet_id, CASE WHEN predicted <> 'Benign' AND confidence < 0.6 THEN 'Benign' ELSE predicted END AS final_label,
  (predicted <> 'Benign' AND confidence < 0.6)::int AS suppressed FROM packets""")
def confidence_gate(spark, sf_dir):
    gated = gate_by_confidence(S.packets(spark, sf_dir))
    return gated.select("packet_id", "final_label", F.col("suppressed").cast("int").alias("suppressed"))


@query(f"WITH {S.PACKETS_SQL} SELECT packet_id, device_id, predicted, confidence FROM packets WHERE predicted <> 'Benign' AND confidence > 0.5")
def alert_gate(spark, sf_dir):
    return S.packets(spark, sf_dir).filter("predicted <> 'Benign' and confidence > 0.5").select(
        "packet_id", "device_id", "predicted", "confidence"
    )


@query("SELECT p_partkey, p_brand, p_type, p_size::bigint AS p_size FROM part")
def drop_high_cardinality(spark, sf_dir):
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint").alias("p_size"))
    return C.drop_high_cardinality(part, 50)
