"""Queries that train, score and read models."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.functions.numeric import round6
from flowquarry.operators import evaluation as E
from flowquarry.operators import models as M
from flowquarry.operators import profiles as P
from flowquarry.operators.scoring import Rule, Test, apply_rules as rule_labels, cascade
from flowquarry.operators.splits import stratified_split as split_rows
from flowquarry.plans.profiling import NAMES, SCORED
from flowquarry.plans.registry import query
from flowquarry.session import fresh_path
from flowquarry.sources import tables as S

_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"""SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) + 0.0 AS price,
  round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) + 0.0 AS size,
  {", ".join(f"(p_type = '{t}')::int::double AS is_{t}" for t in _PART_TYPES)} FROM part""")
def feature_pipeline(spark, sf_dir):
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", "p_type")
    df = M.feature_pipeline(["p_retailprice", "p_size"], ["p_type"]).fit(part).transform(part)
    x = df.select("p_partkey", vector_to_array("features").alias("x"))
    return x.select(
        "p_partkey", round6(F.col("x")[0]).alias("price"), round6(F.col("x")[1]).alias("size"),
        *[F.col("x")[2 + i].alias(f"is_{t}") for i, t in enumerate(_PART_TYPES)],
    )


def labelled_flows(spark, sf_dir, *keys):
    """Flows with their ``keys``, features, class and a 70/15/15 split. No feature is made from the class.

    The split's order is hashed once, into a table in the shared folder: cuts, training and
    scoring read that, and only the columns they need.
    """
    order = dict(zip(("_first", "_second"), S.flow_words()))
    path = fresh_path(spark, "flows")
    df = S.flows(spark, sf_dir).select(*keys, "label", *[quoted(f) for f in S.FEATURES], *[w.alias(n) for n, w in order.items()])
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    return split_rows(df, "label", [F.col(n) for n in order], {"train": 0.70, "val": 0.15, "test": 0.15}).drop(*order)


@contextmanager
def _halves(df):
    """Training and validation rows with what models read, computed and held once."""
    held = df.filter("split <> 'test'").select("label", "split", *[quoted(f) for f in S.FEATURES]).persist()
    try:
        yield held.filter("split = 'train'"), held.filter("split = 'val'")
    finally:
        held.unpersist()


def _chosen(df):
    """The best kind of classifier on the validation rows, trained on the training rows."""
    with _halves(df) as (train, val):
        return M.choose_classifier(train, val, "label", S.FEATURES)[0]


@query()
def train_classifier(spark, sf_dir):
    """Report on the held-out test split of the model chosen on the validation split."""
    df = labelled_flows(spark, sf_dir)
    return E.classification_report(M.score(_chosen(df), df.filter("split = 'test'")), truth="label")


@query()
def train_boosted(spark, sf_dir):
    """Report on the test split of boosted trees whose rounds are chosen on the validation split."""
    df = labelled_flows(spark, sf_dir)
    with _halves(df) as (train, val):
        model = M.train_boosted(train, val, "label", S.FEATURES)
    report = E.classification_report(model.transform(df.filter("split = 'test'")), truth="label")
    return report.withColumn("rounds", F.lit(model.rounds))


@query()
def train_binary(spark, sf_dir):
    df = labelled_flows(spark, sf_dir).withColumn("label", F.when(F.col("label") == "Benign", "Benign").otherwise("Attack"))
    return E.classification_report(M.score(_chosen(df), df.filter("split = 'test'")), truth="label")


@query()
def score_model(spark, sf_dir):
    df = labelled_flows(spark, sf_dir, "flow_id")
    with _halves(df) as (train, _):
        model = M.train_classifier(train, "label", S.FEATURES, kind="tree")
    return M.score(model, df).select("flow_id", "label", "predicted", round6(F.col("confidence")).alias("confidence"))


def _rules(spark, sf_dir):
    df = labelled_flows(spark, sf_dir)
    with _halves(df) as (train, _):
        tree, classes = M.fit_rule_tree(train, "label", S.FEATURES)
        default = M.majority_label(train, "label")
    return df, default, tree, M.extract_rules(tree, S.FEATURES, classes)


@query()
def rule_learner(spark, sf_dir):
    df, default, _, rules = _rules(spark, sf_dir)
    labelled = rule_labels(df.filter("split = 'test'"), rules, default)
    return E.classification_report(labelled, truth="label")


@query()
def extract_rules(spark, sf_dir):
    """Each rule with its text, and its support and precision on the whole table."""
    df, _, _, rules = _rules(spark, sf_dir)
    numbered = [Rule(r.tests, str(i)) for i, r in enumerate(rules)]
    hits = rule_labels(df, numbered, "none", "rule_no").groupBy("rule_no", "label").count()
    texts = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (str(i), r.text())])
    labels = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (str(i), r.label)])
    return hits.groupBy("rule_no").agg(
        F.sum("count").alias("support"),
        (F.sum(F.when(F.col("label") == F.element_at(labels, F.col("rule_no")), F.col("count")).otherwise(0)) / F.sum("count")).alias("precision"),
    ).select("rule_no", F.element_at(texts, F.col("rule_no")).alias("rule"), "support", "precision")


@query()
def tree_importance(spark, sf_dir):
    _, _, tree, _ = _rules(spark, sf_dir)
    return spark.createDataFrame(M.tree_importances(tree, S.FEATURES), "feature string, importance double")


_SAMPLE_RULES = [
    Rule((Test("Rate", True, -0.13), Test("Number", True, -1.0)), "DoS"),
    Rule((Test("Rate", True, -0.13), Test("Number", False, -1.0), Test("IAT", True, 0.0)), "DDoS"),
    Rule((Test("Rate", False, -0.13), Test("Tot size", True, -1.06)), "Recon"),
    Rule((Test("Rate", False, -0.13), Test("Tot size", False, -1.06), Test("Variance", False, 0.17)), "MQTT"),
]


@query(f"""WITH {S.FLOWS_SQL}, z AS (SELECT flow_id, {", ".join(f'("{f}" - (SELECT avg("{f}") FROM flows)) / (SELECT stddev_pop("{f}") FROM flows) AS {a}' for f, a in {**NAMES, "Number": "number"}.items())} FROM flows)
  SELECT flow_id, CASE WHEN rate <= -0.13 AND number <= -1.0 THEN 'DoS' WHEN rate <= -0.13 AND number > -1.0 AND iat <= 0.0 THEN 'DDoS'
    WHEN rate > -0.13 AND size <= -1.06 THEN 'Recon' WHEN rate > -0.13 AND size > -1.06 AND variance > 0.17 THEN 'MQTT' ELSE 'Benign' END AS predicted FROM z""")
def apply_rules(spark, sf_dir):
    df = S.flows(spark, sf_dir)
    scaled = P.fit_scaler(df, [*SCORED, "Number"]).transform(df)
    return rule_labels(scaled, _SAMPLE_RULES, "Benign").select("flow_id", "predicted")


@query(f"""WITH {S.PACKETS_SQL}, c AS (SELECT *, least(rate / 50, 1.0::double) AS sure FROM packets)
  SELECT packet_id, CASE WHEN confidence < 0.75 THEN 'Benign' WHEN sure >= 0.70 AND predicted <> 'Benign' THEN predicted ELSE 'Unknown attack' END AS verdict,
    (confidence >= 0.75 AND sure >= 0.80)::int AS high_confidence FROM c""")
def cascade_predict(spark, sf_dir):
    sure = F.least(F.col("rate") / 50, F.lit(1.0))
    df = cascade(S.packets(spark, sf_dir), F.col("confidence"), F.col("predicted"), sure)
    return df.select("packet_id", "verdict", "high_confidence")


@query()
def ga_select(spark, sf_dir):
    """The subset chosen on the validation rows, its merit, and its tree's test accuracy."""
    df = labelled_flows(spark, sf_dir)
    with _halves(df) as (train, val):
        finalists = M.ga_select(P.mutual_information(train, S.FEATURES), P.correlations(train, S.FEATURES), S.FEATURES, finalists=3)
        chosen, merit, model = M.held_out_choice(train, val, "label", finalists)
    right = M.score(model, df.filter("split = 'test'")).agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))
    return right.select(F.lit(",".join(chosen)).alias("features"), F.lit(merit).alias("merit"), "accuracy")
