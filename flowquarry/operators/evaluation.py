"""Truth against prediction. Everything follows from one (truth, predicted) count table,
which has at most classes x classes rows whatever the size of the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.numeric import share


def pair_counts(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Dense counts: every (truth, predicted) pair of ``classes`` has a row."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = df.sparkSession.range(1).select(F.explode(names).alias("truth"))
    grid = grid.select("truth", F.explode(names).alias("predicted"))
    found = pair_counts(df, truth, predicted)
    return grid.join(found, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(pairs: DataFrame) -> DataFrame:
    """(label, tp, support, claimed, total) for classes seen as truth or prediction."""
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_truth")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_truth")),
    )
    hit = F.col("truth") == F.col("predicted")
    rows = pairs.select("n", hit.alias("hit"), F.explode(sides).alias("s"))
    grouped = rows.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("hit") & (F.col("s.is_truth") == 1), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.is_truth") == 1, n).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_truth") == 0, n).otherwise(0)).alias("claimed"),
    )
    return grouped


def _scores(tp: Column, claimed: Column, support: Column) -> dict[str, Column]:
    precision, recall = share(tp, claimed), share(tp, support)
    return {"precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall)}


def classification_report(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support): a row per class, then accuracy, macro and
    weighted averages. A ratio with nothing below the line is zero."""
    classes = per_class(pair_counts(df, truth, predicted))
    scored = classes.withColumns(_scores(F.col("tp"), F.col("claimed"), F.col("support")))
    total = F.sum("support")
    metrics = ["precision", "recall", "f1"]
    summary = scored.agg(
        total.alias("total"),
        (F.sum("tp") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in metrics],
    )
    accuracy = F.col("accuracy")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in metrics], F.col("total").alias("support")),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in metrics],
                F.col("total").alias("support"),
            )
            for kind in ("macro", "weighted")
        ],
    )
    return scored.select("label", *metrics, "support").unionByName(summary.select(F.explode(rows).alias("r")).select("r.*"))


def balanced_accuracy(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Mean recall over the classes present in the truth."""
    classes = per_class(pair_counts(df, truth, predicted)).filter("support > 0")
    return classes.agg(F.avg(F.col("tp") / F.col("support")).alias("balanced_accuracy"), F.count("*").alias("n_classes"))


def false_positive_rates(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One-against-rest false positive rate per class: fp / (fp + tn)."""
    pairs = pair_counts(df, truth, predicted)
    total = pairs.agg(F.sum("n")).scalar()
    fp = F.col("claimed") - F.col("tp")
    return per_class(pairs).select("label", share(fp, total - F.col("support")).alias("false_positive_rate"))


def outcome(truth: Column, predicted: Column) -> Column:
    """correct, false_positive, missed or wrong_type."""
    return (
        F.when(truth == predicted, "correct")
        .when(truth == "Benign", "false_positive")
        .when(predicted == "Benign", "missed")
        .otherwise("wrong_type")
    )


def outcome_stats(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    pairs = pair_counts(df, truth, predicted)
    total = pairs.agg(F.sum("n")).scalar()
    grouped = pairs.groupBy(outcome(F.col("truth"), F.col("predicted")).alias("outcome")).agg(F.sum("n").alias("n"))
    return grouped.withColumn("percent", F.col("n") / total * 100.0)


def binary_outcomes(df: DataFrame, is_attack: Column, says_attack: Column) -> DataFrame:
    """tp, tn, fp, fn with accuracy and the false positive share of true Benign rows."""
    counts = df.agg(
        F.count_if(is_attack & says_attack).alias("tp"),
        F.count_if(~is_attack & ~says_attack).alias("tn"),
        F.count_if(~is_attack & says_attack).alias("fp"),
        F.count_if(is_attack & ~says_attack).alias("fn"),
    )
    right, benign = F.col("tp") + F.col("tn"), F.col("fp") + F.col("tn")
    return counts.withColumns(
        {"accuracy": share(right, right + F.col("fp") + F.col("fn")), "fp_rate": share(F.col("fp"), benign)}
    )


def false_positive_quality(df: DataFrame, false_positive: Column) -> DataFrame:
    """Share of Benign rows that raised an alert, and its band."""
    counts = df.agg(F.count("*").alias("processed"), F.count_if(false_positive).alias("false_positives"))
    rate = share(F.col("false_positives"), F.col("processed")) * 100.0
    return counts.withColumn("fp_percent", rate).withColumn(
        "band", F.when(F.col("fp_percent") < 5, "excellent").when(F.col("fp_percent") < 15, "acceptable").otherwise("warning")
    )


def gate_stats(df: DataFrame, threshold: float) -> DataFrame:
    """Counts after the confidence gate; a suppressed row is neither attack nor Benign."""
    says = F.col("predicted") != "Benign"
    strong = says & (F.col("confidence") >= threshold)
    truth = F.col("truth") != "Benign"
    return df.agg(
        F.count_if(strong).alias("attacks"),
        F.count_if(~says).alias("benign"),
        F.count_if(says & ~strong).alias("suppressed"),
        F.count_if(strong & ~truth).alias("false_positives"),
        F.count_if(~says & truth).alias("false_negatives"),
    )
