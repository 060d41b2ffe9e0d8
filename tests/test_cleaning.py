"""Edge values of cleaning, labelling and scoring expressions."""

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import labels as L
from flowquarry.functions import numeric as N
from flowquarry.functions.features import interaction_features, log1p_skewed
from flowquarry.operators import cleaning as C
from flowquarry.operators import encoding as E
from flowquarry.operators import evaluation as V
from flowquarry.operators import profiles as P

INF, NAN = float("inf"), float("nan")

NAMES = [
    ("MQTT-DDoS-Connect_Flood_train.pcap.csv", "MQTT", "DDoS", "Connect", "Connect_Flood", "DDoS"),
    ("MQTT-Malformed_Data_train.pcap.csv", "MQTT", "", "", "", "MQTT"),
    ("TCP_IP-DDoS-UDP1_train.pcap.csv", "TCP_IP", "DDoS", "UDP1", "UDP1", "DDoS"),
    ("TCP_IP-DoS-TCP_train.pcap.csv", "TCP_IP", "DoS", "TCP", "TCP", "DoS"),
    ("Recon-OS_Scan_test.pcap.csv", "Recon", "Recon", "OS", "OS_Scan", "Recon"),
    ("ARP_Spoofing_test.pcap.csv", "ARP", "Spoofing", "ARP_Spoofing", "ARP_Spoofing", "Spoofing"),
    ("Benign_train.pcap.csv", "Benign", "Benign", "Benign", "Benign", "Benign"),
    ("other.csv", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown"),
]


@pytest.mark.parametrize("name,protocol,label,legacy,subtype,keyword", NAMES)
def test_names(spark, name, protocol, label, legacy, subtype, keyword):
    df = spark.createDataFrame([(f"file:/x/y/{name}",)], "path string").select(L.basename(F.col("path")).alias("n"))
    c = F.col("n")
    row = df.select(c, L.protocol_of(c), L.label_of(c), L.subtype_of(c), L.subtype_of(c, legacy=False), L.keyword_class(c)).first()
    assert tuple(row) == (name, protocol, label, legacy, subtype, keyword)


def test_number_policies(spark):
    df = spark.createDataFrame([(1.0,), (-0.0,), (NAN,), (None,), (INF,), (-INF,)], "x double")
    assert [r[0] for r in df.select(N.finite_or_null(F.col("x"))).collect()] == [1.0, 0.0, None, None, None, None]
    assert [r[0] for r in df.select(N.finite_or_zero(F.col("x"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    text = spark.createDataFrame([("Infinity",), ("Inf",), ("-inf",), ("nan",), ("abc",), ("",), (None,), ("2.5",)], "x string")
    assert [r[0] for r in text.select(N.finite_or_zero(N.to_double(F.col("x")))).collect()] == [0.0] * 7 + [2.5]
    got = df.select(N.first_finite([F.lit(INF), F.col("x"), F.lit(9.0)])).collect()
    assert [r[0] for r in got] == [1.0, 0.0, 9.0, 9.0, 9.0, 9.0]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (2.0, "a"), (INF, "b"), (None, None), (NAN, "c")], "x double, s string")
    median = [r["x"] for r in C.impute_median(df, ["x"]).collect()]
    assert median == [1.0, 2.0, 2.0, 2.0, 2.0, 2.0]
    mode = C.impute_mode(C.sanitize(df, ["x"]), ["x", "s"]).collect()
    assert mode[4]["s"] == "a" and mode[4]["x"] == 2.0
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r["x"] for r in C.impute_median(empty, ["x"]).collect()] == [None, None]
    assert [r["x"] for r in C.impute_mode(empty, ["x"]).collect()] == [None, None]


def test_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "x double")
    test = spark.createDataFrame([(None,), (9.0,)], "x double")
    assert [r["x"] for r in C.impute_median(test, ["x"], fit_on=train).collect()] == [1.0, 9.0]


def test_schema_tools(spark):
    df = spark.createDataFrame([(1.0, "a", 3)], " Rate string_placeholder".replace("string_placeholder", "double") + ", `Src IP ` string, extra int")
    trimmed = C.trim_names(df)
    assert trimmed.columns == ["Rate", "Src IP", "extra"]
    assert C.drop_leakage(trimmed).columns == ["Rate", "extra"]
    assert C.reindex(trimmed, ["IAT", "Rate"]).first().asDict() == {"IAT": 0.0, "Rate": 1.0}
    assert C.columns_by_type(trimmed) == (["Rate", "extra"], ["Src IP"])
    wide = spark.range(60).select(F.col("id").cast("string").alias("many"), F.lit("x").alias("one"))
    assert C.drop_high_cardinality(wide).columns == ["one"]


def test_labels_kept_and_filled(spark):
    df = spark.createDataFrame([("",), (None,), ("0",), ("Benign",)], "l string")
    assert [r[0] for r in df.filter(L.is_valid_label(F.col("l"))).collect()] == ["Benign"]
    assert [r[0] for r in df.select(L.fill_label(F.col("l"))).collect()] == ["MQTT", "MQTT", "0", "Benign"]
    status = spark.createDataFrame([(None,), (" safe ",), ("Benign",), ("ISOLATED",), ("ddos",)], "s string")
    assert [r[0] for r in status.select(L.status_is_attack(F.col("s"))).collect()] == [False, False, False, True, True]


def test_risk(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (1.0,), (60.0,), (0.81,)], "p double")
    p = N.unit_probability(F.col("p"))
    assert [tuple(r) for r in df.select(p, N.risk_band(p)).collect()] == [
        (0.5, "low"), (0.6, "medium"), (1.0, "high"), (0.6, "medium"), (0.81, "high"),
    ]


def test_derived_features_are_finite(spark):
    columns = "Rate double, Variance double, `Tot size` double, IAT double, Number double"
    df = spark.createDataFrame([(INF, 1.0, 2.0, 3.0, -1.0), (-2.0, None, NAN, 1.0, 1.0), (-1e-5, 0.0, 5.0, 0.0, 0.0)], columns)
    for row in interaction_features(df).collect():
        values = [row[c] for c in row.__fields__[5:]]
        assert len(values) == 8 and all(v is not None and abs(v) < 1e12 for v in values)
    assert log1p_skewed(df.select("Rate")).collect()[1]["Rate"] is None


def test_scaler_with_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = P.fit_scaler(df, ["a", "b"])
    assert [tuple(r) for r in scaler.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_encoders(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("ab",)], "c string")
    codes = E.code_table(train, "c")
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0, "ab": 1, "b": 2}
    test = spark.createDataFrame([("zz",), ("b",), (None,)], "c string")
    assert sorted(r["code"] for r in E.encode(test, "c", codes, "code", 0).collect()) == [0, 0, 2]
    flags = E.dummies(test, "c", E.categories(train, "c")).collect()
    assert [tuple(r) for r in flags] == [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]
    assert {r["c"] for r in E.unseen(train, test.filter("c is not null"), ["c"]).collect()} == {"zz"}


def test_code_table_of_many_values(spark):
    # One shared prefix and many more values than sampled edges.
    df = spark.range(5_000).select(F.format_string("Supplier#%05d", (F.col("id") * 7919) % 5_000).alias("c"))
    rows = E.code_table(df, "c").collect()
    assert sorted((r["value"], r["code"]) for r in rows) == [(f"Supplier#{i:05d}", i) for i in range(5_000)]


def test_report_edges(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "B")], "truth string, predicted string")
    report = {r["label"]: r for r in V.classification_report(df).collect()}
    assert report["C"]["recall"] == 0.0 and report["B"]["support"] == 0 and report["B"]["precision"] == 0.0
    assert report["accuracy"]["f1"] == pytest.approx(1 / 3)
    assert V.balanced_accuracy(df).first()["balanced_accuracy"] == pytest.approx(0.25)
    one = df.filter("truth = 'A'")
    assert V.binary_outcomes(one, F.lit(True), F.lit(True)).first()["fp_rate"] == 0.0


def test_published_class_weights():
    # Training counts implied by the published sample sizes and a 70% stratified split.
    n = 1_925_465
    assert P.balanced_weight(n, 2, 11_967) == pytest.approx(80.4489, abs=1e-4)
    counts = [11_967, 1_376_139, 503_464, 1_414, 27_877, 4_604]
    weights = [26.8163, 0.2332, 0.6374, 226.9525, 11.5117, 69.7026]
    assert [P.balanced_weight(n, 6, c) for c in counts] == pytest.approx(weights, abs=1e-4)


def test_published_scenario_totals(spark):
    rows = [("Benign", "Benign")] * 150 + [("DDoS", "DDoS")] * 105 + [("Benign", "DoS")] * 21 + [("MQTT", "Benign")] * 3 + [("DoS", "DDoS")] * 20
    df = spark.createDataFrame(rows, "truth string, predicted string")
    got = {r["outcome"]: (r["n"], round(r["percent"], 1)) for r in V.outcome_stats(df).collect()}
    assert got == {"correct": (255, 85.3), "false_positive": (21, 7.0), "missed": (3, 1.0), "wrong_type": (20, 6.7)}
