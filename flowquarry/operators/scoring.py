"""From model output to status, risk, cascade verdicts and rule verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted

# Status threshold and cascade thresholds.
STATUS_GATE = 0.5
CASCADE = {"binary": 0.75, "multiclass": 0.70, "high_confidence": 0.80}


def assess(df: DataFrame, gate: float = STATUS_GATE) -> DataFrame:
    """ATTACK if not Benign and sure enough; risk is the confidence, else its complement.

    A weak attack is SAFE yet keeps a high risk score, as the original definition has it.
    """
    attack = (F.col("predicted") != "Benign") & (F.col("confidence") > gate)
    text = F.format_string("Detected %s with %.2f confidence.", F.col("predicted"), F.round("confidence", 6))
    return df.withColumns(
        {
            "device_status": F.when(attack, "ATTACK").otherwise("SAFE"),
            "risk_score": F.when(attack, F.col("confidence")).otherwise(1.0 - F.col("confidence")),
            "summary_text": F.when(attack, text).otherwise("Normal traffic detected."),
        }
    )


def cascade(df: DataFrame, attack_probability: Column, label: Column, confidence: Column) -> DataFrame:
    """Binary stage first; only its attacks reach the class stage.

    A confident class is reported, marked high when very confident; an unsure one is
    reported as an attack of unknown type.
    """
    passed = attack_probability >= CASCADE["binary"]
    sure = confidence >= CASCADE["multiclass"]
    return df.withColumns(
        {
            "verdict": F.when(~passed, "Benign").when(sure & (label != "Benign"), label).otherwise("Unknown attack"),
            "high_confidence": (passed & (confidence >= CASCADE["high_confidence"])).cast("int"),
        }
    )


@dataclass(frozen=True)
class Test:
    """One comparison of a rule: feature <= threshold or feature > threshold."""

    feature: str
    at_most: bool
    threshold: float

    def column(self) -> Column:
        x = quoted(self.feature)
        return (x <= self.threshold) if self.at_most else (x > self.threshold)

    def text(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.threshold:.4f}"


@dataclass(frozen=True)
class Rule:
    """All tests hold => label. Paths of one tree never overlap."""

    tests: tuple[Test, ...]
    label: str

    def column(self) -> Column:
        result = F.lit(True)
        for t in self.tests:
            result = result & t.column()
        return result

    def text(self) -> str:
        return f"{' AND '.join(t.text() for t in self.tests) or 'TRUE'} => {self.label}"


def first_holding(rules: Sequence[Rule], depth: int = 0) -> Column:
    """Label of the first rule whose tests from ``depth`` on hold, else null.

    Neighbouring rules that begin alike share that test, so the paths of a tree are tested as
    the tree they came from: a row meets a few tests a level instead of every path's own.
    """
    parts = []
    for first, run in groupby(rules, lambda rule: rule.tests[depth] if len(rule.tests) > depth else None):
        run = list(run)
        parts.append(F.lit(run[0].label) if first is None else F.when(first.column(), first_holding(run, depth + 1)))
    return F.coalesce(*parts)


def apply_rules(df: DataFrame, rules: list[Rule], default: str, output: str = "predicted") -> DataFrame:
    """Label of the first rule that holds, else the default; one projection."""
    return df.withColumn(output, F.coalesce(first_holding(rules), F.lit(default)) if rules else F.lit(default))
