"""Per-class and per-feature statistics, and the scalers and scorers fitted from them.

Statistics are computed wide, one aggregation over all features with map-side combine,
and only the small result is turned long. Fitted objects hold (classes x features)
numbers on the driver and apply them as literals, so scoring is a plain projection that
works the same on a batch and on a stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.features import computed_once, quoted
from flowquarry.operators.order_statistics import order_statistics, quantile_table


def _long(wide: DataFrame, keys: Sequence[str], features: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Columns named stat_i, i numbering features, to rows (keys, feature, stats)."""
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{s}_{i}").alias(s) for s in stats])
            for i, f in enumerate(features)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def class_profile(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(label, feature, min, max, mean, std, count); std is the population form."""
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop, "count": F.count}
    wide = df.groupBy(label).agg(
        *[fn(quoted(f)).alias(f"{s}_{i}") for i, f in enumerate(features) for s, fn in stats.items()]
    )
    return _long(wide, [label], features, list(stats))


def class_prototypes(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(label, feature, mean, median, count) with exact medians."""
    wide = df.groupBy(label).agg(
        *[fn(quoted(f)).alias(f"{s}_{i}") for i, f in enumerate(features) for s, fn in (("mean", F.avg), ("count", F.count))]
    )
    means = _long(wide, [label], features, ["mean", "count"])
    medians = quantile_table(df, features, 0.5, label).withColumnRenamed("value", "median")
    return means.join(medians.withColumnRenamed("label", label), [label, "feature"])


@dataclass
class Scaler:
    """Centre and spread per feature; a constant feature keeps spread one."""

    features: list[str]
    means: list[float]
    stds: list[float]

    def columns(self) -> dict[str, Column]:
        return {
            f: (quoted(f) - F.lit(m)) / F.lit(s if s else 1.0)
            for f, m, s in zip(self.features, self.means, self.stds)
        }

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    row = df.agg(
        *[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(quoted(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).collect()[0]
    n = len(features)
    return Scaler(list(features), [row[f"m{i}"] or 0.0 for i in range(n)], [row[f"s{i}"] or 0.0 for i in range(n)])


@dataclass
class PrototypeModel:
    """Scores a row by its squared distance to each class mean in scaled space.

    Probabilities are softmax(-distance); ties go to the class that sorts first.
    """

    scaler: Scaler
    classes: list[str]
    centres: list[list[float]]

    def distances(self) -> list[Column]:
        scaled = list(self.scaler.columns().values())
        result = []
        for centre in self.centres:
            total = None
            for x, c in zip(scaled, centre):
                term = (x - F.lit(c)) * (x - F.lit(c))
                total = term if total is None else total + term
            result.append(total)
        return result

    def probability(self, rows: np.ndarray, name: str) -> np.ndarray:
        """The probability of one class for a matrix of rows x features."""
        scaled = (rows - np.array(self.scaler.means)) / np.array([s or 1.0 for s in self.scaler.stds])
        near = ((scaled - np.array(self.centres[self.classes.index(name)])) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            odds = sum(np.exp(near - ((scaled - np.array(c)) ** 2).sum(axis=1)) for c in self.centres)
        return 1.0 / odds

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``distances`` and ``probabilities`` (class order), ``predicted``,
        ``confidence`` and ``distance`` of the winner."""
        names = [f"_d{i}" for i in range(len(self.classes))]
        df = computed_once(df, dict(zip(names, self.distances())))
        # Relative to the nearest class, so that a far outlier's weights don't all underflow.
        nearest = F.least(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
        df = df.withColumn("_near", nearest)
        weights = [F.exp(F.col("_near") - F.col(n)) for n in names]
        df = df.withColumn("_w", sum(weights[1:], weights[0]))
        classes = F.array(*[F.lit(c) for c in self.classes])
        winner = F.array_position("distances", F.array_min("distances")).cast("int")
        return (
            df.withColumns(
                {
                    "distances": F.array(*[F.col(n) for n in names]),
                    "probabilities": F.array(*[w / F.col("_w") for w in weights]),
                }
            )
            .withColumns(
                {
                    "predicted": F.element_at(classes, winner),
                    "distance": F.array_min("distances"),
                    "confidence": F.array_max("probabilities"),
                }
            )
            .drop(*names, "_w", "_near")
        )


#: Exponents up to which products of two exponentials neither overflow nor vanish.
FAR = 300.0
#: Rows times background rows of which odds are held at once.
ODDS_AT_ONCE = 200_000


@dataclass
class OtherClass:
    """The probability that a row is not of class ``name``, and its means over mixed rows.

    The odds against the class are a sum over classes of exp(a sum over features), for the
    squares in the two distances cancel. So the odds of a row mixed with a background row are
    one product of (rows x classes) and (classes x background) per coalition.
    """

    model: PrototypeModel
    name: str

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 - self.model.probability(rows, self.name)

    def _terms(self, rows: np.ndarray) -> np.ndarray:
        """(classes x rows x features): what a feature adds to the logarithm of a class's odds."""
        scaled = (rows - np.array(self.model.scaler.means)) / np.array([s or 1.0 for s in self.model.scaler.stds])
        centres = np.array(self.model.centres)[:, None, :]
        own = centres[self.model.classes.index(self.name)]
        with np.errstate(invalid="ignore"):
            return (centres - own) * (2 * scaled - own - centres)

    def _direct(self, rows: np.ndarray, background: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(rows): sums over the background, one mixed row at a time."""
        total = np.zeros(len(rows))
        for one in background:
            total += self(np.where(mask, rows, one))
        return total

    def coalition_values(self, rows: np.ndarray, background: np.ndarray, masks: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(masks)))
        behind = self._terms(background)
        close = np.abs(behind).sum(axis=2).max(axis=0) <= FAR
        behind, beyond = behind[:, close], background[~close]
        step = max(1, ODDS_AT_ONCE // len(background))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            terms = self._terms(part)
            near = np.abs(terms).sum(axis=2).max(axis=0) <= FAR
            terms = terms[:, near]
            for i, mask in enumerate(masks):
                total = np.empty(len(part))
                odds = np.exp(terms[:, :, mask].sum(axis=2)).T @ np.exp(behind[:, :, ~mask].sum(axis=2))
                total[near] = odds.shape[1] - np.reciprocal(odds, out=odds).sum(axis=1)
                if len(beyond):
                    total[near] += self._direct(part[near], beyond, mask)
                if not near.all():
                    total[~near] = self._direct(part[~near], background, mask)
                out[start : start + step, i] = total / len(background)
        return out


def fit_prototypes(df: DataFrame, features: Sequence[str], label: str = "label", fit_scaler_on: DataFrame | None = None) -> PrototypeModel:
    """One pass for the scaler, one for the class means; scaling is affine, so class means
    are taken unscaled and scaled afterwards."""
    scaler = fit_scaler(df if fit_scaler_on is None else fit_scaler_on, features)
    rows = df.groupBy(label).agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]).collect()
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    centres = [
        [(r[f"m{i}"] - scaler.means[i]) / (scaler.stds[i] or 1.0) for i in range(len(features))] for r in rows
    ]
    return PrototypeModel(scaler, [r[0] for r in rows], centres)


def binned_counts(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 16) -> DataFrame:
    """(feature, bin, label, n) over equal-width bins between each feature's extremes."""
    row = df.agg(
        *[F.min(quoted(f)).alias(f"lo{i}") for i, f in enumerate(features)],
        *[F.max(quoted(f)).alias(f"hi{i}") for i, f in enumerate(features)],
    ).collect()[0]
    entries = []
    for i, f in enumerate(features):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        position = F.floor((quoted(f) - F.lit(lo)) / F.lit(width) * F.lit(float(bins)))
        entries.append(F.struct(F.lit(f).alias("feature"), F.least(position, F.lit(bins - 1)).cast("int").alias("bin")))
    return (
        df.select(F.col(label).alias("label"), F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.feature", "e.bin", "label")
        .agg(F.count("*").alias("n"))
    )


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = 16) -> dict[str, list[float]]:
    """The values of rank ceil(j n / bins), j below ``bins``, of each feature, equal ones once.

    They come from counting passes, not from a sort; ``bins`` - 1 numbers a feature reach the driver.
    """
    names = {f"c{i}": f for i, f in enumerate(features)}
    found = order_statistics(
        df,
        {k: quoted(f).cast("double") for k, f in names.items()},
        lambda _g, _n, n: [-(-j * n // bins) for j in range(1, bins)] if n else [],
    )
    return {f: sorted({float(v[0]) for v in found.get((None, k), ()) if v is not None}) for k, f in names.items()}


def quantile_binned_counts(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 16) -> DataFrame:
    """(feature, bin, label, n) over bins of about equal counts: a value's bin is the number of
    cuts below it, so equal values share a bin. A feature with few distinct values has fewer
    bins; missing values (null, NaN) are a bin of their own, null."""
    entries = []
    for f, cuts in quantile_cuts(df, features, bins).items():
        value = quoted(f).cast("double")
        below = sum(((value > F.lit(c)).cast("int") for c in cuts), F.lit(0))
        entries.append(F.struct(F.lit(f).alias("feature"), F.when(value.isNotNull() & ~F.isnan(value), below).alias("bin")))
    return (
        df.select(F.col(label).alias("label"), F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.feature", "e.bin", "label")
        .agg(F.count("*").alias("n"))
    )


def mutual_information(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 16, equal_counts: bool = False) -> DataFrame:
    """(feature, mi, position) in nats, best first. Counts are (features x bins x classes).

    Bins are of equal width, or with ``equal_counts`` between quantiles, so that a skewed
    feature does not fall into one bin.
    """
    counts = (quantile_binned_counts if equal_counts else binned_counts)(df, features, label, bins)
    of_feature = Window.partitionBy("feature")
    # In doubles: products of counts outgrow a long.
    n, total = F.col("n").cast("double"), F.sum("n").over(of_feature).cast("double")
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin")).cast("double")
    by_label = F.sum("n").over(Window.partitionBy("feature", "label")).cast("double")
    parts = counts.select("feature", (n / total * F.log(n * total / (by_bin * by_label))).alias("part"))
    mi = parts.groupBy("feature").agg(F.sum("part").alias("mi"))
    return mi.withColumn("position", F.row_number().over(Window.orderBy(F.round("mi", 9).desc(), "feature")))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair a < b in list order, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    wide = df.agg(*[F.corr(quoted(a), quoted(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k * count) per class and its softened square root."""


    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.withColumn("weight", weight).withColumn("soft_weight", F.sqrt("weight"))


def balanced_weight(n: int, k: int, count: int) -> float:
    return n / (k * count) if count else math.inf
