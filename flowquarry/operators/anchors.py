"""Anchor rules by beam search: rules grow by one predicate a round until they are sure enough.

A predicate says that a feature lies in a bin. Each round counts, in one pass without moving
rows, how the rows that match a rule of the beam fall into the bins of the other features; the
counts have at most (rules of the beam x predicates x classes) rows. A rule is an anchor of its
class when the lower confidence bound of its precision reaches the wanted one. Of the others
the best few of each class are extended.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted

PRECISION = 0.95
BEAM = 4
ROUNDS = 3
BINS = 16
#: Rules of a beam times classes that a row is held against.
MOST_RULES = 512
#: Quantile of the normal distribution for a one-sided bound of 95 %.
Z = 1.645


def lower_bound(hits: float, n: float, z: float = Z) -> float:
    """Wilson's lower confidence bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@dataclass(frozen=True)
class Rule:
    """Predicates (feature, bin) in the order of the features, and what they say of a class."""

    predicates: tuple[tuple[int, int], ...]
    label: str
    n: int
    hits: int

    @property
    def lower(self) -> float:
        return lower_bound(self.hits, self.n)


def bin_columns(features: Sequence[str], edges: dict[str, tuple[float, float]], bins: int) -> list[Column]:
    """The bin of each feature, from 0; values beyond the edges fall into the outer bins. A
    missing value has none: greatest and least would skip it."""
    out = []
    for f in features:
        lo, hi = edges[f]
        width = hi - lo if hi > lo else 1.0
        place = F.floor((quoted(f) - F.lit(lo)) / F.lit(width) * F.lit(float(bins)))
        there = quoted(f).isNotNull() & ~F.isnan(quoted(f))
        out.append(F.when(there, F.greatest(F.lit(0), F.least(place, F.lit(bins - 1))).cast("int")))
    return out


def _extensions(binned: DataFrame, beam: list[tuple[tuple[int, int], ...]], width: int) -> list:
    """(rule, feature, bin, label, n) counts of the rows that match a rule of the beam."""
    matches = [F.lit(True) if not rule else None for rule in beam]
    for i, rule in enumerate(beam):
        for feature, at in rule:
            one = F.col(f"b{feature}") == at
            matches[i] = one if matches[i] is None else matches[i] & one
    rules = F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(matches)]))
    held = binned.select("label", *[f"b{f}" for f in range(width)], F.explode(rules).alias("rule"))
    every = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b{f}").alias("bin")) for f in range(width)])
    long = held.select("label", "rule", F.inline(every)).filter(F.col("bin").isNotNull())
    return long.groupBy("rule", "feature", "bin", "label").agg(F.count("*").alias("n")).collect()


def anchor_beam(
    df: DataFrame, features: Sequence[str], edges: dict[str, tuple[float, float]], label: str,
    precision: float = PRECISION, beam: int = BEAM, rounds: int = ROUNDS, bins: int = BINS,
) -> DataFrame:
    """(label, round, rule, n, precision, lower, coverage, anchor) of every rule of a beam and
    every anchor found on the way. ``label`` is the class to explain: the prediction.

    A row with a missing feature matches no predicate of it. A class without anchor after the
    last round keeps the best rules it has, told by ``anchor``.
    """
    width = len(features)
    binned = df.select(F.col(label).alias("label"), *[c.alias(f"b{i}") for i, c in enumerate(bin_columns(features, edges, bins))])
    total = df.count()
    classes = sorted(r[0] for r in binned.select("label").distinct().collect() if r[0] is not None)
    if beam * len(classes) > MOST_RULES:
        raise ValueError(f"{len(classes)} classes with beams of {beam}: at most {MOST_RULES} rules are searched at once")
    parents: dict[str, list[tuple]] = {c: [()] for c in classes}
    kept: list[tuple[int, Rule]] = []
    for step in range(1, rounds + 1):
        wanted = sorted({p for rules in parents.values() for p in rules})
        if not wanted:
            break
        counts: dict[tuple, dict[str, int]] = {}
        for r in _extensions(binned, wanted, width):
            held = wanted[r["rule"]]
            if r["feature"] not in {f for f, _ in held}:
                counts.setdefault((r["rule"], r["feature"], r["bin"]), {})[r["label"]] = r["n"]
        parent_of = {rule: i for i, rule in enumerate(wanted)}
        following: dict[str, list[tuple]] = {}
        for c in classes:
            grown: dict[tuple, Rule] = {}
            mine = {parent_of[p] for p in parents[c]}
            for (rule, feature, at), by_label in counts.items():
                if rule in mine:
                    predicates = tuple(sorted((*wanted[rule], (feature, at))))
                    grown[predicates] = Rule(predicates, c, sum(by_label.values()), by_label.get(c, 0))
            anchors = [r for r in grown.values() if r.lower >= precision]
            open_rules = [r for r in grown.values() if r.lower < precision]
            # The surest rules go on; of equal ones the wider, then the one of earlier features.
            best = sorted(open_rules, key=lambda r: (-round(r.lower, 9), -r.n, r.predicates))[:beam]
            following[c] = [r.predicates for r in best]
            kept += [(step, r) for r in anchors + best]
        parents = following
    rows = [
        (r.label, step, [f"{features[f]}={at}" for f, at in r.predicates], r.n, r.hits / r.n, r.lower, r.n / total, r.lower >= precision)
        for step, r in kept
    ]
    schema = "label string, round int, rule array<string>, n long, precision double, lower double, coverage double, anchor boolean"
    return df.sparkSession.createDataFrame(rows, schema)
