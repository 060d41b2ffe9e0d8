"""Class labels read out of capture-file names and out of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Traffic classes, in class-index order.
CLASSES = ["Benign", "DDoS", "DoS", "MQTT", "Recon", "Spoofing"]

# Capture-name prefix and the protocol it stands for.
PROTOCOL_PREFIXES = {
    "MQTT-": "MQTT",
    "TCP_IP-": "TCP_IP",
    "Recon-": "Recon",
    "ARP_": "ARP",
    "Benign": "Benign",
}

# Keyword looked for in a capture name, and its class; the first hit counts.
KEYWORD_CLASSES = {
    "benign": "Benign",
    "ddos": "DDoS",
    "dos": "DoS",
    "mqtt": "MQTT",
    "recon": "Recon",
    "spoof": "Spoofing",
}


def first_match(tests: list[tuple[Column, str]], default: str) -> Column:
    """Value of the first test that holds."""
    chain = F
    for test, value in tests:
        chain = chain.when(test, F.lit(value))
    return chain.otherwise(F.lit(default))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _prefix(name: Column) -> Column:
    """The known prefix of a capture name, empty if it has none."""
    return F.regexp_extract(name, f"^({'|'.join(PROTOCOL_PREFIXES)})", 1)


def _by_prefix(name: Column, values: dict[str, str], otherwise: Column) -> Column:
    """A fixed value for some prefixes, ``otherwise`` for the rest. The name is looked at
    once, which keeps the expression small when Spark copies it into a filter."""
    known = F.create_map(*[F.lit(x) for kv in {**values, "": "Unknown"}.items() for x in kv])
    return F.coalesce(F.try_element_at(known, _prefix(name)), otherwise)


def protocol_of(name: Column) -> Column:
    return _by_prefix(name, PROTOCOL_PREFIXES, F.lit("Unknown"))


def label_of(name: Column) -> Column:
    """Class by name prefix; hyphenated names carry it in their second part."""
    second_part = F.regexp_extract(name, r"^[^-]+-([^-]+)-", 1)
    return _by_prefix(name, {"Recon-": "Recon", "ARP_": "Spoofing", "Benign": "Benign"}, second_part)


def subtype_of(name: Column, legacy: bool = True) -> Column:
    """Attack variant. ``legacy`` stops at the first underscore ("Connect" for
    Connect_Flood); otherwise everything before _train/_test is kept."""
    tail = r"([^_]+)_" if legacy else r"(.+)_(?:train|test)"
    last_part = F.regexp_extract(name, rf"^(?:Recon|[^-]+-[^-]+)-{tail}", 1)
    return _by_prefix(name, {"ARP_": "ARP_Spoofing", "Benign": "Benign"}, last_part)


def keyword_class(name: Column) -> Column:
    lowered = F.lower(name)
    return first_match([(lowered.contains(k), v) for k, v in KEYWORD_CLASSES.items()], "Unknown")


def fill_label(label: Column, default: str = "MQTT") -> Column:
    """Names without a second hyphen leave an empty label; those captures are MQTT."""
    return F.when(F.trim(label) != "", label).otherwise(F.lit(default))


def is_valid_label(label: Column) -> Column:
    return ~F.coalesce(label, F.lit("")).isin("", "0")


def binary_target(label: Column) -> Column:
    return (label != "Benign").cast("int")


def status_is_attack(status: Column) -> Column:
    """Anything but SAFE or BENIGN counts as under attack; null counts as SAFE."""
    return ~F.upper(F.trim(F.coalesce(status, F.lit("SAFE")))).isin("SAFE", "BENIGN")


def label_is_threat(label: Column) -> Column:
    return ~F.upper(label).isin("BENIGN", "NORMAL", "SAFE")


def severity_of(log_type: Column) -> Column:
    return first_match(
        [
            (log_type.contains("SUCCESS"), "success"),
            (log_type.contains("WARNING"), "warning"),
            (log_type.contains("DANGER") | log_type.contains("ATTACK"), "danger"),
        ],
        "info",
    )
