"""The flow feature set and derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.numeric import finite_or_zero, safe_log1p

# The 39 flow features in model order.
FLOW_FEATURES = [
    "Header_Length", "Protocol Type", "Time_To_Live", "Rate", "fin_flag_number", "syn_flag_number",
    "rst_flag_number", "psh_flag_number", "ack_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "rst_count", "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH",
    "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP", "IGMP", "IPv", "LLC", "Tot sum", "Min", "Max", "AVG",
    "Std", "Tot size", "IAT", "Number", "Variance",
]

# Columns that identify a record or give its class away, by use.
LEAKAGE_COLUMNS = {
    "training": [
        "Source IP", "Destination IP", "Timestamp", "Flow ID", "Source Port", "Destination Port", "Unnamed: 0",
        "source_file", "basename", "SubType", "Src IP", "Dst IP", "MAC", "Prob", "Flow Duration", "Time", "Protocol",
    ],
    "windows": [
        "Timestamp", "timestamp", "Source IP", "Destination IP", "Flow ID", "Source Port", "Destination Port",
        "Unnamed: 0", "source_file", "basename", "SubType", "Src IP", "Dst IP", "MAC", "Prob", "Flow Duration", "Time",
    ],
    "scoring": [
        "source_file", "basename", "SubType", "Flow ID", "Src IP", "Dst IP", "Source IP", "Destination IP",
        "Timestamp", "Label", "Protocol", "Flow Duration", "Source Port", "Destination Port", "Time", "MAC",
    ],
}

# Features that get log1p before scaling, where present.
SKEWED_FEATURES = [
    "Rate", "Variance", "Tot size", "IAT", "Number", "Magnitue", "Radius", "Covariance", "Kurtosis", "Skewness",
]

# Column names tried in order for the traffic part of an alert.
RATE_CANDIDATES = ["Rate", "Flow Bytes/s", "Fwd Bytes/s"]
SIZE_CANDIDATES = ["Tot size", "Tot Size", "Total Length", "Max", "Len", "Pkt Len Mean"]
PROTOCOL_CANDIDATES = ["Protocol Type", "Protocol", "Proto"]


def quoted(name: str) -> Column:
    """Column by exact name, spaces and dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read instead of recomputing.

    Spark copies a projected expression into every filter pushed below it; the output of
    a one-row generator is not copied. It costs no shuffle and works on streams.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def interaction_features(df: DataFrame) -> DataFrame:
    """Eight derived columns; whatever is not a finite number becomes zero."""
    rate, variance, size = quoted("Rate"), quoted("Variance"), quoted("Tot size")
    iat, number = quoted("IAT"), quoted("Number")
    derived = {
        "Rate_Variance": rate * variance,
        "Rate_IAT": rate * iat,
        "Size_Rate_Ratio": F.try_divide(size, rate + F.lit(1e-5)),
        "Log_Rate": safe_log1p(rate),
        "Log_Variance": safe_log1p(variance),
        "Log_Tot_Size": safe_log1p(size),
        "Log_Duration": safe_log1p(number * iat),
        "Size_Per_Packet": F.try_divide(size, number + F.lit(1.0)),
    }
    return df.withColumns({name: finite_or_zero(c) for name, c in derived.items()})


def log1p_skewed(df: DataFrame) -> DataFrame:
    present = [c for c in SKEWED_FEATURES if c in df.columns]
    return df.withColumns({c: safe_log1p(quoted(c)) for c in present})


def title_of(feature: Column) -> Column:
    """Readable name for a feature without a description."""
    return F.initcap(F.replace(feature, F.lit("_"), F.lit(" ")))
