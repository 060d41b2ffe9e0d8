"""JSON artifacts: per-class profiles, importance, descriptions and model config."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.features import FLOW_FEATURES

# Readable feature names.
FEATURE_DESCRIPTIONS = {
    "Header_Length": "Header Length", "Protocol Type": "Protocol Type", "Time_To_Live": "Time To Live",
    "Rate": "Network Traffic Speed", "fin_flag_number": "Number of Packets", "syn_flag_number": "Number of Packets",
    "rst_flag_number": "Number of Packets", "psh_flag_number": "Number of Packets",
    "ack_flag_number": "Number of Packets", "ece_flag_number": "Number of Packets",
    "cwr_flag_number": "Number of Packets", "ack_count": "Ack Count", "syn_count": "Syn Count",
    "fin_count": "Fin Count", "rst_count": "Rst Count", "HTTP": "Http", "HTTPS": "Https", "DNS": "Dns",
    "Telnet": "Telnet", "SMTP": "Smtp", "SSH": "Ssh", "IRC": "Irc", "TCP": "Tcp", "UDP": "Udp", "DHCP": "Dhcp",
    "ARP": "Arp", "ICMP": "Icmp", "IGMP": "Igmp", "IPv": "Ipv", "LLC": "Llc",
    "Tot sum": "Total Packet Size Summary", "Min": "Minimum Packet Size", "Max": "Maximum Packet Size",
    "AVG": "Average Packet Size", "Std": "Packet Size Variation", "Tot size": "Total Data Volume",
    "IAT": "Time Between Packets", "Number": "Number of Packets", "Variance": "Data Variability",
}

PROFILE_ENTRY = "struct<min: array<double>, max: array<double>, mean: array<double>, std: array<double>, count: bigint>"
PROTOTYPE_ENTRY = "struct<mean: array<double>, median: array<double>, count: bigint>"


def _json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(key, value, place) rows of one JSON object; no rows if the file is missing."""
    schema = f"map<string, {value_type}>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], f"place int, key string, value {value_type}")
    parsed = text.select(F.from_json("value", schema).alias("m"))
    return parsed.select(F.posexplode(F.map_entries("m")).alias("place", "e")).select("place", "e.key", "e.value")


def read_profiles(spark: SparkSession, path: str, features: list[str] = FLOW_FEATURES) -> DataFrame:
    """Parallel arrays per class to rows (label, feature, min, max, mean, std, count)."""
    rows = _json_map(spark, path, PROFILE_ENTRY).filter("key not like '\\\\_%'")
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.arrays_zip(
        names.alias("feature"), F.col("value.min").alias("min"), F.col("value.max").alias("max"),
        F.col("value.mean").alias("mean"), F.col("value.std").alias("std"),
    )
    return rows.select(F.col("key").alias("label"), F.explode(zipped).alias("z"), F.col("value.count").alias("count")).select(
        "label", "z.feature", "z.min", "z.max", "z.mean", "z.std", "count"
    )


def read_prototypes(spark: SparkSession, path: str, features: list[str] = FLOW_FEATURES) -> DataFrame:
    rows = _json_map(spark, path, PROTOTYPE_ENTRY).filter("key not like '\\\\_%'")
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.arrays_zip(names.alias("feature"), F.col("value.mean").alias("mean"), F.col("value.median").alias("median"))
    return rows.select(F.col("key").alias("label"), F.explode(zipped).alias("z"), F.col("value.count").alias("count")).select(
        "label", "z.feature", "z.mean", "z.median", "count"
    )


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """(feature, importance, position); position follows the value, then the file order."""
    from pyspark.sql import Window

    rows = _json_map(spark, path, "double")
    order = Window.orderBy(F.col("value").desc(), "place")
    return rows.select(F.col("key").alias("feature"), F.col("value").alias("importance"), F.row_number().over(order).alias("position"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    rows = _json_map(spark, path, "string")
    return rows.select(F.col("key").alias("feature"), F.col("value").alias("description"))
