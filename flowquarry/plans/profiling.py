"""Queries over class statistics, scoring by prototypes, and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowquarry.functions import labels as L
from flowquarry.functions.features import quoted, title_of
from flowquarry.functions.numeric import round6
from flowquarry.operators import evaluation as E
from flowquarry.operators import profiles as P
from flowquarry.operators.alerts import CONFIDENCE_GATE
from flowquarry.operators.order_statistics import quantile_table
from flowquarry.plans.registry import query
from flowquarry.sources import tables as S

SCORED = ["Rate", "Tot size", "IAT", "Variance"]
NAMES = {"Rate": "rate", "Tot size": "size", "IAT": "iat", "Variance": "variance"}

# Long form of the flows used by several oracles.
LONG_SQL = (
    S.FLOWS_SQL
    + """, long AS (SELECT flow_id, label, 'Rate' AS feature, "Rate" AS v FROM flows
  UNION ALL SELECT flow_id, label, 'Tot size', "Tot size" FROM flows
  UNION ALL SELECT flow_id, label, 'IAT', "IAT" FROM flows
  UNION ALL SELECT flow_id, label, 'Variance', "Variance" FROM flows)"""
)

# Scaled features, class means, and every (flow, class) distance.
SCORED_SQL = (
    S.FLOWS_SQL
    + """, params AS (SELECT """
    + ", ".join(f'avg("{f}") AS m_{a}, stddev_pop("{f}") AS s_{a}' for f, a in NAMES.items())
    + """ FROM flows),
scaled AS (SELECT flow_id, label, device_id, ts, """
    + ", ".join(f'("{f}" - m_{a}) / s_{a} AS {a}' for f, a in NAMES.items())
    + """ FROM flows, params),
proto AS (SELECT label AS c, """
    + ", ".join(f"avg({a}) AS c_{a}" for a in NAMES.values())
    + """ FROM scaled GROUP BY label),
dist AS (SELECT flow_id, label, c, """
    + " + ".join(f"({a} - c_{a}) * ({a} - c_{a})" for a in NAMES.values())
    + """ AS d FROM scaled, proto),
ranked AS (SELECT *, exp(-d) / sum(exp(-d)) OVER (PARTITION BY flow_id) AS p,
  row_number() OVER (PARTITION BY flow_id ORDER BY round(d, 9), c) AS place FROM dist),
scored AS (SELECT flow_id, label, c AS predicted, d AS distance, p AS confidence FROM ranked WHERE place = 1)"""
)


def scored_flows(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    return P.fit_prototypes(df, SCORED).transform(df)


@query(f"""WITH {SCORED_SQL}, classes AS (SELECT DISTINCT label AS l FROM flows) SELECT t.l AS truth, p.l AS predicted, count(s.flow_id) AS n
  FROM classes t CROSS JOIN classes p LEFT JOIN scored s ON s.label = t.l AND s.predicted = p.l GROUP BY t.l, p.l""")
def prototype_confusion(spark, sf_dir):
    return E.confusion_matrix(scored_flows(spark, sf_dir), L.CLASSES, truth="label")


@query(f"WITH {SCORED_SQL} SELECT flow_id, predicted, round(distance, 6) + 0.0 AS distance FROM scored")
def nearest_prototype(spark, sf_dir):
    return scored_flows(spark, sf_dir).select("flow_id", "predicted", round6(F.col("distance")).alias("distance"))


@query(f"WITH {SCORED_SQL} SELECT flow_id, predicted, round(confidence, 6) + 0.0 AS confidence FROM scored")
def score_batch(spark, sf_dir):
    return scored_flows(spark, sf_dir).select("flow_id", "predicted", round6(F.col("confidence")).alias("confidence"))


@query(f"""WITH {SCORED_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY round(p, 9) DESC, c) AS r FROM ranked)
  SELECT flow_id, c AS predicted, round(p, 6) + 0.0 AS confidence, list_position(['Benign', 'DDoS', 'DoS', 'MQTT', 'Recon', 'Spoofing'], c)::int - 1 AS class_index FROM q WHERE r = 1""")
def argmax_class(spark, sf_dir):
    df = scored_flows(spark, sf_dir).withColumn("r", F.transform("probabilities", lambda p: F.round(p, 9)))
    index = F.array_position("r", F.array_max("r")) - 1
    classes = F.array(*[F.lit(c) for c in L.CLASSES])
    return df.select(
        "flow_id",
        F.element_at(classes, (index + 1).cast("int")).alias("predicted"),
        round6(F.col("confidence")).alias("confidence"),
        index.cast("int").alias("class_index"),
    )


@query(f"""WITH {SCORED_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY round(p, 9) DESC, c DESC) AS r FROM ranked)
  SELECT flow_id, max(CASE WHEN r = 1 THEN c END) AS winner, round(max(CASE WHEN r = 1 THEN p END), 6) + 0.0 AS winner_p,
    max(CASE WHEN r = 2 THEN c END) AS runner_up, round(max(CASE WHEN r = 2 THEN p END), 6) + 0.0 AS runner_up_p FROM q GROUP BY flow_id""")
def probability_split(spark, sf_dir):
    classes = F.array(*[F.lit(c) for c in L.CLASSES])
    ordered = F.sort_array(
        F.zip_with("probabilities", classes, lambda p, c: F.struct(F.round(p, 9).alias("r"), c.alias("c"), p.alias("p"))),
        asc=False,
    )
    df = scored_flows(spark, sf_dir).select("flow_id", ordered.alias("o"))
    return df.select(
        "flow_id",
        F.col("o")[0]["c"].alias("winner"), round6(F.col("o")[0]["p"]).alias("winner_p"),
        F.col("o")[1]["c"].alias("runner_up"), round6(F.col("o")[1]["p"]).alias("runner_up_p"),
    )


@query(f"""WITH {SCORED_SQL} SELECT flow_id, CASE WHEN attack THEN 'ATTACK' ELSE 'SAFE' END AS device_status,
  round(CASE WHEN attack THEN confidence ELSE 1 - confidence END, 6) + 0.0 AS risk_score,
  CASE WHEN attack THEN 'Detected ' || predicted || ' with ' || printf('%.2f', round(confidence, 6)) || ' confidence.' ELSE 'Normal traffic detected.' END AS summary_text
  FROM (SELECT *, predicted <> 'Benign' AND confidence > 0.2 AS attack FROM scored)""")
def risk_assessment(spark, sf_dir):
    from flowquarry.operators.scoring import assess

    # Six near-equal classes: the gate sits just above chance instead of at one half.
    df = assess(scored_flows(spark, sf_dir), gate=0.2)
    return df.select("flow_id", "device_status", round6(F.col("risk_score")).alias("risk_score"), "summary_text")


@query(f"""WITH {S.FLOWS_SQL} SELECT label, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 6) AS percent FROM flows GROUP BY label""")
def label_distribution(spark, sf_dir):
    counts = S.flows(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", round6(F.col("n") * 100.0 / total).alias("percent")).orderBy(F.desc("n"), "label")


@query(f"""WITH {LONG_SQL} SELECT label, feature, min(v) AS min, max(v) AS max, round(avg(v), 4) + 0.0 AS mean,
  round(stddev_pop(v), 4) + 0.0 AS std, count(*) AS count FROM long GROUP BY label, feature""")
def class_profile(spark, sf_dir):
    df = P.class_profile(S.flows(spark, sf_dir), SCORED)
    return df.select("label", "feature", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count")


@query(f"""WITH {LONG_SQL} SELECT label, feature, round(avg(v), 4) + 0.0 AS mean, quantile_disc(v, 0.5) AS median, count(*) AS count
  FROM long GROUP BY label, feature""")
def class_prototypes(spark, sf_dir):
    df = P.class_prototypes(S.flows(spark, sf_dir), SCORED)
    return df.select("label", "feature", F.round("mean", 4).alias("mean"), "median", "count")


@query(f"WITH {LONG_SQL} SELECT feature, quantile_disc(v, 0.5) AS median FROM long GROUP BY feature")
def median_disc(spark, sf_dir):
    return quantile_table(S.flows(spark, sf_dir), SCORED, 0.5).withColumnRenamed("value", "median")


@query(f"""WITH {S.FLOWS_SQL}, c AS (SELECT label, count(*) AS n FROM flows GROUP BY label), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
  SELECT label, n, round(total / (k * n)::double, 6) AS weight, round(sqrt(total / (k * n)::double), 6) AS soft_weight FROM c, t""")
def class_weights(spark, sf_dir):
    df = P.class_weights(S.flows(spark, sf_dir))
    return df.select("label", "n", round6(F.col("weight")).alias("weight"), round6(F.col("soft_weight")).alias("soft_weight"))


@query(f"""WITH {S.FLOWS_SQL}, p AS (SELECT """ + ", ".join(f'avg("{f}") AS m_{a}, stddev_pop("{f}") AS s_{a}' for f, a in NAMES.items())
  + """ FROM flows WHERE l_linenumber <= 5) SELECT flow_id, """
  + ", ".join(f'round(("{f}" - m_{a}) / s_{a}, 6) + 0.0 AS {a}' for f, a in NAMES.items()) + ", 0.0::double AS flat FROM flows, p")
def standardize(spark, sf_dir):
    df = S.flows(spark, sf_dir).withColumn("flat", F.lit(7.5))
    scaler = P.fit_scaler(df.filter("l_linenumber <= 5"), [*SCORED, "flat"])
    names = {**NAMES, "flat": "flat"}
    return scaler.transform(df).select("flow_id", *[round6(quoted(f)).alias(a) for f, a in names.items()])


@query(f"""WITH {LONG_SQL}, w AS (SELECT flow_id, {", ".join(f'"{f}" AS {a}' for f, a in NAMES.items())} FROM flows)
  SELECT 'Rate' AS a, 'Tot size' AS b, round(corr(rate, size), 6) + 0.0 AS corr FROM w UNION ALL SELECT 'Rate', 'IAT', round(corr(rate, iat), 6) + 0.0 FROM w
  UNION ALL SELECT 'Rate', 'Variance', round(corr(rate, variance), 6) + 0.0 FROM w UNION ALL SELECT 'Tot size', 'IAT', round(corr(size, iat), 6) + 0.0 FROM w
  UNION ALL SELECT 'Tot size', 'Variance', round(corr(size, variance), 6) + 0.0 FROM w UNION ALL SELECT 'IAT', 'Variance', round(corr(iat, variance), 6) + 0.0 FROM w""")
def feature_correlation(spark, sf_dir):
    return P.correlations(S.flows(spark, sf_dir), SCORED).select("a", "b", round6(F.col("corr")).alias("corr"))


MI_SQL = (
    S.PACKETS_SQL
    + """, f AS (SELECT truth AS label, 'rate' AS feature, rate AS v FROM packets
  UNION ALL SELECT truth, 'confidence', confidence FROM packets
  UNION ALL SELECT truth, 'hour', extract(hour FROM ts)::double FROM packets
  UNION ALL SELECT truth, 'device', device_id::double FROM packets),
e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM f GROUP BY feature),
b AS (SELECT f.feature, label, least(floor((v - lo) / (hi - lo) * 16), 15) AS bin, count(*)::double AS n
  FROM f JOIN e USING (feature) GROUP BY ALL),
m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nb,
  sum(n) OVER (PARTITION BY feature, label) AS nl FROM b),
mi AS (SELECT feature, sum(n / total * ln(n * total / (nb * nl))) AS mi FROM m GROUP BY feature)"""
)
MI_FEATURES = ["rate", "confidence", "hour", "device"]


def _mi(spark, sf_dir):
    df = S.packets(spark, sf_dir).select(
        F.col("truth").alias("label"), "rate", "confidence",
        F.hour("ts").cast("double").alias("hour"), F.col("device_id").cast("double").alias("device"),
    )
    return P.mutual_information(df, MI_FEATURES)


@query(f"WITH {MI_SQL} SELECT feature, round(mi, 6) + 0.0 AS mi, row_number() OVER (ORDER BY round(mi, 9) DESC, feature)::int AS position FROM mi")
def mutual_information(spark, sf_dir):
    return _mi(spark, sf_dir).select("feature", round6(F.col("mi")).alias("mi"), "position")


SKEWED_SQL = """f AS (SELECT l_returnflag AS label, 'price' AS feature, l_extendedprice::double AS v FROM lineitem
  UNION ALL SELECT l_returnflag, 'skewed', exp(l_extendedprice::double / 10000) FROM lineitem
  UNION ALL SELECT l_returnflag, 'discount', l_discount::double FROM lineitem
  UNION ALL SELECT l_returnflag, 'day', date_diff('day', DATE '1992-01-01', l_shipdate::date)::double FROM lineitem),
r AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM f),
cuts AS (SELECT feature, list(DISTINCT v) AS c FROM r, range(1, 16) j(j) WHERE rn = (j * n + 15) // 16 GROUP BY feature),
b AS (SELECT f.feature, label, len(list_filter(c, lambda x: x < v)) AS bin, count(*)::double AS n FROM f JOIN cuts USING (feature) GROUP BY ALL),
m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nb,
  sum(n) OVER (PARTITION BY feature, label) AS nl FROM b),
mi AS (SELECT feature, sum(n / total * ln(n * total / (nb * nl))) AS mi FROM m GROUP BY feature)"""


@query(f"WITH {SKEWED_SQL} SELECT feature, round(mi, 6) + 0.0 AS mi, row_number() OVER (ORDER BY round(mi, 9) DESC, feature)::int AS position FROM mi")
def mutual_information_quantiles(spark, sf_dir):
    """Bins between quantiles: a feature and its exponential tell the same of the class."""
    df = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_extendedprice").cast("double").alias("price"),
        F.exp(F.col("l_extendedprice").cast("double") / 10000).alias("skewed"), F.col("l_discount").cast("double").alias("discount"),
        F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("day"),
    )
    found = P.mutual_information(df, ["price", "skewed", "discount", "day"], equal_counts=True)
    return found.select("feature", round6(F.col("mi")).alias("mi"), "position")


@query(f"""WITH {MI_SQL} SELECT feature, round(mi, 6) + 0.0 AS mi, row_number() OVER (ORDER BY round(mi, 9) DESC, feature)::int AS from_top,
  row_number() OVER (ORDER BY round(mi, 9), feature DESC)::int AS from_bottom FROM mi WHERE mi >= 0.01""")
def select_by_mi(spark, sf_dir):
    kept = _mi(spark, sf_dir).filter("mi >= 0.01")
    top = Window.orderBy(F.round("mi", 9).desc(), "feature")
    bottom = Window.orderBy(F.round("mi", 9), F.desc("feature"))
    return kept.select(
        "feature", round6(F.col("mi")).alias("mi"),
        F.row_number().over(top).alias("from_top"), F.row_number().over(bottom).alias("from_bottom"),
    )


@query(f"""WITH {S.PACKETS_SQL}, g AS (SELECT * FROM (VALUES ('Benign'), ('DDoS'), ('DoS'), ('MQTT'), ('Recon'), ('Spoofing')) v(c))
  SELECT t.c AS truth, q.c AS predicted, count(p.packet_id) AS n FROM g t CROSS JOIN g q LEFT JOIN packets p ON p.truth = t.c AND p.predicted = q.c GROUP BY t.c, q.c""")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(S.packets(spark, sf_dir), L.CLASSES)


REPORT_SQL = (
    S.PACKETS_SQL
    + """, c AS (SELECT DISTINCT truth AS label FROM packets UNION SELECT DISTINCT predicted FROM packets),
k AS (SELECT label, (SELECT count(*) FROM packets WHERE truth = label AND predicted = label) AS tp,
    (SELECT count(*) FROM packets WHERE truth = label) AS support, (SELECT count(*) FROM packets WHERE predicted = label) AS claimed FROM c),
r AS (SELECT label, tp, support, claimed, CASE WHEN claimed = 0 THEN 0.0::double ELSE tp / claimed::double END AS pr,
    CASE WHEN support = 0 THEN 0.0::double ELSE tp / support::double END AS re FROM k),
s AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0::double ELSE 2 * pr * re / (pr + re) END AS f FROM r)"""
)


@query(f"""WITH {REPORT_SQL}, a AS (SELECT label, pr, re, f, support FROM s
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support)::double, sum(tp) / sum(support)::double, sum(tp) / sum(support)::double, sum(support)::bigint FROM s
  UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(support)::bigint FROM s
  UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f * support) / sum(support), sum(support)::bigint FROM s)
  SELECT label, round(pr, 6) + 0.0 AS precision, round(re, 6) + 0.0 AS recall, round(f, 6) + 0.0 AS f1, support FROM a""")
def classification_report(spark, sf_dir):
    df = E.classification_report(S.packets(spark, sf_dir))
    return df.select("label", *[round6(F.col(m)).alias(m) for m in ("precision", "recall", "f1")], "support")


@query(f"WITH {REPORT_SQL} SELECT round(avg(re), 6) AS balanced_accuracy, count(*) AS n_classes FROM s WHERE support > 0")
def balanced_accuracy(spark, sf_dir):
    df = E.balanced_accuracy(S.packets(spark, sf_dir))
    return df.select(round6(F.col("balanced_accuracy")).alias("balanced_accuracy"), "n_classes")


@query(f"""WITH {REPORT_SQL} SELECT label, round((claimed - tp) / ((SELECT count(*) FROM packets) - support)::double, 6) + 0.0 AS false_positive_rate FROM s""")
def false_positive_rate(spark, sf_dir):
    df = E.false_positive_rates(S.packets(spark, sf_dir))
    return df.select("label", round6(F.col("false_positive_rate")).alias("false_positive_rate"))


@query(f"""WITH {S.PACKETS_SQL}, o AS (SELECT CASE WHEN truth = predicted THEN 'correct' WHEN truth = 'Benign' THEN 'false_positive'
    WHEN predicted = 'Benign' THEN 'missed' ELSE 'wrong_type' END AS outcome FROM packets)
  SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM packets)::double * 100, 6) AS percent FROM o GROUP BY outcome""")
def outcome_stats(spark, sf_dir):
    return E.outcome_stats(S.packets(spark, sf_dir)).select("outcome", "n", round6(F.col("percent")).alias("percent"))


@query(f"""WITH {S.PACKETS_SQL}, o AS (SELECT truth <> 'Benign' AS t, upper(predicted) NOT IN ('BENIGN', 'NORMAL', 'SAFE') AS p FROM packets),
  c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM o)
  SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn)::double, 6) AS accuracy, round(fp / (fp + tn)::double, 6) AS fp_rate FROM c""")
def binary_outcomes(spark, sf_dir):
    df = E.binary_outcomes(S.packets(spark, sf_dir), F.col("truth") != "Benign", L.label_is_threat(F.col("predicted")))
    return df.select("tp", "tn", "fp", "fn", round6(F.col("accuracy")).alias("accuracy"), round6(F.col("fp_rate")).alias("fp_rate"))


@query(f"""WITH {S.PACKETS_SQL}, c AS (SELECT count(*) AS processed, count(*) FILTER (predicted <> 'Benign' AND confidence >= 0.3) AS false_positives FROM packets WHERE truth = 'Benign')
  SELECT processed, false_positives, round(false_positives / processed::double * 100, 6) AS fp_percent,
    CASE WHEN false_positives * 100.0 / processed < 5 THEN 'excellent' WHEN false_positives * 100.0 / processed < 15 THEN 'acceptable' ELSE 'warning' END AS band FROM c""")
def fp_quality(spark, sf_dir):
    benign = S.packets(spark, sf_dir).filter("truth = 'Benign'")
    df = E.false_positive_quality(benign, (F.col("predicted") != "Benign") & (F.col("confidence") >= 0.3))
    return df.select("processed", "false_positives", round6(F.col("fp_percent")).alias("fp_percent"), "band")


@query(f"""WITH {S.PACKETS_SQL} SELECT count(*) FILTER (predicted <> 'Benign' AND confidence >= 0.6) AS attacks, count(*) FILTER (predicted = 'Benign') AS benign,
  count(*) FILTER (predicted <> 'Benign' AND confidence < 0.6) AS suppressed, count(*) FILTER (predicted <> 'Benign' AND confidence >= 0.6 AND truth = 'Benign') AS false_positives,
  count(*) FILTER (predicted = 'Benign' AND truth <> 'Benign') AS false_negatives FROM packets""")
def gate_stats(spark, sf_dir):
    return E.gate_stats(S.packets(spark, sf_dir), CONFIDENCE_GATE)


IMPORTANCE_SQL = (
    LONG_SQL
    + """, g AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY feature),
bg AS (SELECT feature, avg(CASE WHEN label = 'Benign' THEN v END) AS mb, avg(CASE WHEN label <> 'Benign' THEN v END) AS ma FROM long GROUP BY feature),
phi AS (SELECT flow_id, label, feature, v, ((ma - mb) / s) * ((v - mb) / s) AS phi FROM long JOIN g USING (feature) JOIN bg USING (feature)),
imp AS (SELECT feature, avg(abs(phi)) AS a FROM phi GROUP BY feature),
ranked_imp AS (SELECT feature, a / sum(a) OVER () AS importance, row_number() OVER (ORDER BY round(a, 12) DESC, feature)::int AS position FROM imp)"""
)


def importance_table(spark, sf_dir):
    from flowquarry.operators.explain import fit_linear, global_importance as importance

    df = S.flows(spark, sf_dir)
    return importance(df, fit_linear(df, SCORED))


@query(f"WITH {IMPORTANCE_SQL} SELECT feature, round(importance, 6) + 0.0 AS importance, position FROM ranked_imp")
def global_importance(spark, sf_dir):
    return importance_table(spark, sf_dir).select("feature", round6(F.col("importance")).alias("importance"), "position")


@query(f"""WITH {IMPORTANCE_SQL}, d AS (SELECT * FROM (VALUES ('Rate', 'Network Traffic Speed'), ('IAT', 'Time Between Packets'), ('Tot size', 'Total Data Volume')) v(feature, description))
  SELECT feature, round(importance, 6) + 0.0 AS importance, position, coalesce(description, feature) AS description FROM ranked_imp LEFT JOIN d USING (feature)""")
def feature_catalog(spark, sf_dir):
    from flowquarry.sources.artifacts import FEATURE_DESCRIPTIONS

    # Variance has no description here, so the fallback title is exercised.
    held = {k: v for k, v in FEATURE_DESCRIPTIONS.items() if k != "Variance"}
    known = F.create_map(*[F.lit(x) for kv in held.items() for x in kv])
    df = importance_table(spark, sf_dir)
    return df.select(
        "feature", round6(F.col("importance")).alias("importance"), "position",
        F.coalesce(F.try_element_at(known, F.col("feature")), title_of(F.col("feature"))).alias("description"),
    )
