"""Why a flow was flagged: attributions, baseline deviation, messages, anchor rules and
counterfactuals. Row-level work is projection over fitted literals; nothing is collected
but (features x classes) parameters."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted, title_of
from flowquarry.functions.hashing import WORD
from flowquarry.operators.profiles import PrototypeModel, Scaler

# Message wording and thresholds of the two-audience explanation.
NO_BASELINE = ("Unusual network behavior detected.", "Insufficient baseline data.")
NO_ANOMALY = ("Unusual network behavior detected.", "No significant anomalies identified.")
PLAIN = "%s son derece %s. Normal hasta izleme trafiğine kıyasla %dx kat daha fazladır."
SEVERITY = {5: "ekstremdir", 2: "yüksektir"}
SEVERITY_ELSE = "düzensizdir"
TECHNICAL = "Feature '%s' | Rank: #%d | Z-Score: %s | Value: %.1f"
TOP_FEATURES = 5


@dataclass
class LinearModel:
    """score(x) = sum w_j * scaled(x_j), explained against a background point."""

    scaler: Scaler
    weights: list[float]
    background: list[float]

    @property
    def features(self) -> list[str]:
        return self.scaler.features

    @property
    def base(self) -> float:
        return sum(w * b for w, b in zip(self.weights, self.background))

    def contributions(self) -> list[Column]:
        """Exact Shapley values of a linear score: w_j * (x_j - background_j)."""
        scaled = self.scaler.columns()
        return [F.lit(w) * (scaled[f] - F.lit(b)) for f, w, b in zip(self.features, self.weights, self.background)]

    def score(self) -> Column:
        parts = self.contributions()
        return sum(parts[1:], F.lit(self.base) + parts[0])


def fit_linear(df: DataFrame, features: Sequence[str], label: str = "label") -> LinearModel:
    """Weights are attack mean minus Benign mean in scaled space; background is Benign."""
    benign = F.col(label) == "Benign"
    row = df.agg(
        *[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(quoted(f)).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.avg(F.when(benign, quoted(f))).alias(f"b{i}") for i, f in enumerate(features)],
        *[F.avg(F.when(~benign, quoted(f))).alias(f"a{i}") for i, f in enumerate(features)],
    ).collect()[0]
    n = range(len(features))
    stds = [row[f"s{i}"] or 0.0 for i in n]
    scaler = Scaler(list(features), [row[f"m{i}"] for i in n], stds)
    weights = [(row[f"a{i}"] - row[f"b{i}"]) / (stds[i] or 1.0) for i in n]
    background = [(row[f"b{i}"] - row[f"m{i}"]) / (stds[i] or 1.0) for i in n]
    return LinearModel(scaler, weights, background)


def force_record(model: LinearModel) -> Column:
    """{base_value, final_value, features[{name, value, phi}]}."""
    entries = [
        F.struct(F.lit(f).alias("name"), quoted(f).alias("value"), phi.alias("phi"))
        for f, phi in zip(model.features, model.contributions())
    ]
    return F.struct(
        F.lit(model.base).alias("base_value"), model.score().alias("final_value"), F.array(*entries).alias("features")
    )


def attribution_rows(df: DataFrame, model: LinearModel, keep: Sequence[str]) -> DataFrame:
    """Long (keep, feature, value, phi) rows."""
    record = df.select(*keep, force_record(model).alias("r"))
    return record.select(*keep, F.explode("r.features").alias("e")).select(
        *keep, F.col("e.name").alias("feature"), F.col("e.value").alias("value"), F.col("e.phi").alias("phi")
    )


def global_importance(df: DataFrame, model: LinearModel) -> DataFrame:
    """(feature, importance, position): mean |phi| as a share of the total."""
    wide = df.agg(*[F.avg(F.abs(phi)).alias(f"a{i}") for i, phi in enumerate(model.contributions())])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("a")) for i, f in enumerate(model.features)])
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return long.select(
        "feature",
        (F.col("a") / F.sum("a").over(Window.partitionBy())).alias("importance"),
        F.row_number().over(Window.orderBy(F.round("a", 12).desc(), "feature")).alias("position"),
    )


def top_contributions(model: LinearModel, k: int) -> Column:
    """The k largest contributions as an array of {feature, contribution, impact}."""
    entries = []
    for i, (f, phi) in enumerate(zip(model.features, model.contributions())):
        value = F.round(phi, 4) + F.lit(0.0)
        entries.append(
            F.struct(
                (-F.abs(value)).alias("key"), F.lit(i).alias("i"), F.lit(f).alias("feature"), value.alias("contribution"),
                F.when(value > 0, "positive").otherwise("negative").alias("impact"),
            )
        )
    return F.slice(F.sort_array(F.array(*entries)), 1, k)


@dataclass
class Baseline:
    """Benign mean and spread per feature, and each feature's importance rank."""

    features: list[str]
    means: list[float]
    stds: list[float]
    ranks: dict[str, int]


def fit_baseline(df: DataFrame, features: Sequence[str], ranks: dict[str, int], label: str = "label") -> Baseline:
    row = df.filter(F.col(label) == "Benign").agg(
        *[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(quoted(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).collect()[0]
    n = range(len(features))
    return Baseline(list(features), [row[f"m{i}"] for i in n], [row[f"s{i}"] or 0.0 for i in n], dict(ranks))


def baseline_deviation(df: DataFrame, base: Baseline, top: int = TOP_FEATURES) -> DataFrame:
    """Adds ``critical``: {deviation, feature, rank, z, value} of the important feature
    furthest from Benign traffic, or null when nothing deviates. Values and baseline are
    both in raw units. Equal deviations go to the earlier feature."""
    entries = []
    for i, f in enumerate(base.features):
        mean, std, rank = base.means[i], base.stds[i], base.ranks.get(f)
        if rank is None or rank > top or not mean:
            continue
        gap = quoted(f) - F.lit(mean)
        entries.append(
            F.struct(
                (F.abs(gap) / F.lit(abs(mean) + 1e-6)).alias("deviation"), F.lit(-i).alias("order"),
                F.lit(f).alias("feature"), F.lit(rank).alias("rank"),
                (gap / F.lit(std) if std > 0 else F.lit(None).cast("double")).alias("z"), quoted(f).alias("value"),
            )
        )
    if not entries:
        empty = "struct<deviation:double,order:int,feature:string,rank:int,z:double,value:double>"
        return df.withColumn("critical", F.lit(None).cast(empty))
    best = F.greatest(*entries) if len(entries) > 1 else entries[0]
    return df.withColumn("_best", best).withColumn("critical", F.when(F.col("_best.deviation") > 0, F.col("_best"))).drop("_best")


def dual_messages(description: Column) -> dict[str, Column]:
    """Plain and technical texts from ``critical``; ``description`` names the feature."""
    c = F.col("critical")
    deviation, z = c["deviation"], c["z"]
    severity = F.lit(SEVERITY_ELSE)
    for limit in sorted(SEVERITY):
        severity = F.when(deviation > limit, F.lit(SEVERITY[limit])).otherwise(severity)
    factor = F.when(deviation > min(SEVERITY), F.floor(deviation)).otherwise(F.lit(2)).cast("bigint")
    name = F.coalesce(description, title_of(c["feature"]))
    shown_z = F.coalesce(F.format_string("%+.1f", z), F.lit("n/a"))
    return {
        "plain": F.when(c.isNull(), NO_ANOMALY[0]).otherwise(F.format_string(PLAIN, name, severity, factor)),
        "technical": F.when(c.isNull(), NO_ANOMALY[1]).otherwise(
            F.format_string(TECHNICAL, c["feature"], c["rank"], shown_z, c["value"])
        ),
    }


# --- Shapley values for any scorer ---------------------------------------------------


def exact_shapley(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    background: dict[str, float],
    score: Callable[[np.ndarray], np.ndarray],
    groups: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """(key, part, phi) over all 2^parts coalitions; the parts of a row add up to
    score(row) - score(background). A row with a missing feature has null phi.

    ``score`` turns a matrix of rows x features into scores. All coalitions of an Arrow
    batch are scored in place, so there is no shuffle. The work doubles with each part:
    beyond about a dozen, group them or use :func:`sampled_shapley`.
    """
    parts = [list(g) for g in (groups or [[f] for f in features])]
    n = len(parts)
    columns = [[list(features).index(f) for f in g] for g in parts]
    point = np.array([background[f] for f in features])

    def values(*series: pd.Series) -> pd.DataFrame:
        rows = np.column_stack([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        phi = np.zeros((len(rows), n))
        for mask in range(1 << n):
            mixed = np.tile(point, (len(rows), 1))
            for i, places in enumerate(columns):
                if mask >> i & 1:
                    mixed[:, places] = rows[:, places]
            v = score(mixed)
            for i in range(n):
                # The score counts for a part that is in the coalition, else against it.
                weight = 1.0 / (n * math.comb(n - 1, (mask & ~(1 << i)).bit_count()))
                phi[:, i] += weight * v if mask >> i & 1 else -weight * v
        phi[np.isnan(phi).any(axis=1)] = np.nan
        return pd.DataFrame({f"p{i}": phi[:, i] for i in range(n)})

    schema = ", ".join(f"p{i} double" for i in range(n))
    scored = df.select(key, F.pandas_udf(values, schema)(*[quoted(f).cast("double") for f in features]).alias("_phi"))
    entries = [F.struct(F.lit("+".join(g)).alias("part"), F.col(f"_phi.p{i}").alias("phi")) for i, g in enumerate(parts)]
    return scored.select(key, F.inline(F.array(*entries)))


def sampled_shapley(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    background: dict[str, float],
    score: Callable[[DataFrame], DataFrame],
    permutations: int = 100,
    groups: Sequence[Sequence[str]] | None = None,
    seed: int = 42,
) -> DataFrame:
    """(key, part, phi) by permutation sampling; the parts of a row add up to
    score(row) - score(background).

    ``score`` adds a ``score`` column to rows of features. Each row is expanded to its
    coalitions in the same task, so the sums per key combine before the shuffle. The
    sampled permutations are shared by all rows. Use :func:`exact_shapley` where the
    coalitions can be counted.
    """
    parts = [list(g) for g in (groups or [[f] for f in features])]
    n = len(parts)
    rng = random.Random(seed)
    # place[i][p]: the step at which permutation p adds part i, counted from one.
    orders = [rng.sample(range(n), n) for _ in range(permutations)]
    place = [[order.index(i) + 1 for order in orders] for i in range(n)]
    case = F.explode(F.sequence(F.lit(0), F.lit(permutations * (n + 1) - 1)))
    expanded = df.select(key, *[quoted(f) for f in features]).withColumn("_case", case)
    expanded = expanded.withColumns({"_perm": F.expr(f"_case div {n + 1}").cast("int") + 1, "_step": F.col("_case") % (n + 1)})
    added = [F.element_at(F.array(*[F.lit(p) for p in place[i]]), F.col("_perm")) for i in range(n)]
    mixed = expanded.withColumns(
        {
            f: F.when(added[i] <= F.col("_step"), quoted(f)).otherwise(F.lit(background[f]))
            for i, g in enumerate(parts)
            for f in g
        }
    )
    # A part's effect is the score just after it joins less the score just before.
    value = F.col("score") / F.lit(float(permutations))
    effects = [
        F.sum(F.when(F.col("_step") == a, value).when(F.col("_step") == a - 1, -value).otherwise(F.lit(0.0))).alias(f"_phi{i}")
        for i, a in enumerate(added)
    ]
    wide = score(mixed).groupBy(key).agg(*effects)
    rows = F.array(*[F.struct(F.lit("+".join(g)).alias("part"), F.col(f"_phi{i}").alias("phi")) for i, g in enumerate(parts)])
    return wide.select(key, F.explode(rows).alias("r")).select(key, "r.part", "r.phi")


def correlated_groups(correlations: DataFrame, features: Sequence[str], threshold: float = 0.5) -> list[list[str]]:
    """Features joined whenever |corr| reaches the threshold; (features^2) rows at most."""
    group = {f: {f} for f in features}
    for r in correlations.filter(F.abs("corr") >= threshold).collect():
        merged = group[r["a"]] | group[r["b"]]
        for f in merged:
            group[f] = merged
    seen: list[list[str]] = []
    for f in features:
        members = [x for x in features if x in group[f]]
        if members not in seen:
            seen.append(members)
    return seen


# --- anchor rules --------------------------------------------------------------------


def anchor_rules(
    df: DataFrame, features: Sequence[str], edges: dict[str, tuple[float, float]], label: str,
    precision: float = 0.85, bins: int = 16,
) -> DataFrame:
    """Predicates "feature in bin" that hold one class with the wanted precision, and
    pairs of predicates built from those that do not reach it alone. ``label`` is the class
    to explain: the prediction, for rules that say what the model does.

    Singles and pairs are counted in one map-side-combined aggregation; the count table
    has at most (predicates^2 x classes) rows.
    """
    bin_of = {}
    for f in features:
        lo, hi = edges[f]
        width = hi - lo if hi > lo else 1.0
        position = F.floor((quoted(f) - F.lit(lo)) / F.lit(width) * F.lit(float(bins)))
        bin_of[f] = F.greatest(F.lit(0), F.least(position, F.lit(bins - 1))).cast("int")
    nothing = (F.lit(None).cast("string"), F.lit(None).cast("int"))

    def predicate(a, b=None):
        second = nothing if b is None else (F.lit(b), quoted(f"_b_{b}"))
        return F.struct(F.lit(a).alias("f1"), quoted(f"_b_{a}").alias("b1"), second[0].alias("f2"), second[1].alias("b2"))

    binned = df.select(F.col(label).alias("label"), *[c.alias(f"_b_{f}") for f, c in bin_of.items()])
    candidates = F.array(*[predicate(f) for f in features], *[predicate(a, b) for a, b in combinations(features, 2)])
    counts = (
        binned.select("label", F.explode(candidates).alias("p"))
        .groupBy("p.f1", "p.b1", "p.f2", "p.b2", "label")
        .agg(F.count("*").alias("n"))
    )
    covered = F.sum("n").over(Window.partitionBy("f1", "b1", "f2", "b2"))
    total = df.agg(F.count("*")).scalar()
    rules = counts.select(
        "f1", "b1", "f2", "b2", "label", (F.col("n") / covered).alias("precision"), (covered / total).alias("coverage")
    ).filter(F.col("precision") >= precision)
    singles = rules.filter("f2 is null")
    done = singles.select(F.col("f1").alias("f"), F.col("b1").alias("b"))
    pairs = (
        rules.filter("f2 is not null")
        .join(done, (F.col("f1") == F.col("f")) & (F.col("b1") == F.col("b")), "left_anti")
        .join(done, (F.col("f2") == F.col("f")) & (F.col("b2") == F.col("b")), "left_anti")
    )
    return singles.unionByName(pairs)


# --- counterfactuals -------------------------------------------------------------------

# The walk to a prototype goes this share of the rest of the way beyond the crossing.
OVERSHOOT = 0.01


def random_counterfactuals(
    df: DataFrame, key: str, model: PrototypeModel, tries: int = 8, wanted: str = "Benign"
) -> DataFrame:
    """For rows not predicted ``wanted``: the nearest changed row that is, among ``tries``
    hash-drawn perturbations of up to two spreads per feature and the point just beyond the
    crossing on the straight way to the ``wanted`` prototype (try -1).

    Along that way the distances to two prototypes differ by something linear, so the
    crossing is a closed form. It exists for every row whose values are finite, unless
    another prototype coincides with the wanted one. Each row is settled within its Arrow
    batch, with no shuffle.

    Adds ``counterfactual``: {distance, try, features...}; null only without a crossing.
    """
    features = model.scaler.features
    n = len(features)
    words = -(-n // 4)
    means, stds = np.array(model.scaler.means), np.array([s or 1.0 for s in model.scaler.stds])
    target = model.classes.index(wanted)
    centre = np.array(model.centres[target])
    others = np.array([c for k, c in enumerate(model.centres) if k != target])

    def beyond(points: np.ndarray) -> np.ndarray:
        """How much further each other prototype is than the wanted one."""
        near = ((points - centre) ** 2).sum(axis=1)
        return np.column_stack([((points - c) ** 2).sum(axis=1) - near for c in others])

    def nearest(draws: pd.Series, *series: pd.Series) -> pd.DataFrame:
        raw = np.column_stack([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        x = (raw - means) / stds
        # Sixteen bytes of digest are four numbers; the rest of the last block is unused.
        units = np.frombuffer(bytes.fromhex("".join(draws)), dtype=">u4") / float(WORD)
        moves = (units * 4.0 - 2.0).reshape(len(x), tries, words * 4)[:, :, :n]
        # The crossing with each other prototype, as a share of the way.
        here = beyond(x)
        there = ((others - centre) ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where(here <= 0, -here / (there - here), 0.0).max(axis=1, initial=0.0)
        reached = at < 1.0
        at = at + (1.0 - at) * OVERSHOOT
        best = at[:, None] * (centre - x)
        far = np.where(reached, np.sqrt((best**2).sum(axis=1)), np.inf)
        chosen = np.where(reached, -1, -2)
        for t in range(tries):
            step = moves[:, t]
            length = np.sqrt((step**2).sum(axis=1))
            hit = (beyond(x + step) > 0).all(axis=1) & (length < far)
            far, chosen = np.where(hit, length, far), np.where(hit, t, chosen)
            best = np.where(hit[:, None], step, best)
        moved = np.where((chosen > -2)[:, None], raw + best * stds, np.nan)
        out = {"far": far, "try": chosen.astype(np.int32)}
        return pd.DataFrame(out | {f"x{i}": moved[:, i] for i in range(n)})

    blocks = [F.md5(F.concat_ws(":", F.col(key), F.lit(t), F.lit(b)).cast("binary")) for t in range(tries) for b in range(words)]
    schema = ", ".join(["far double", "try int", *[f"x{i} double" for i in range(n)]])
    settled = F.pandas_udf(nearest, schema)(F.concat(*blocks), *[quoted(f).cast("double") for f in features])
    found = F.struct(
        F.col("_best.far").alias("distance"), F.col("_best.try").alias("try"), *[F.col(f"_best.x{i}").alias(f) for i, f in enumerate(features)]
    )
    return df.withColumn("_best", settled).withColumn("counterfactual", F.when(F.col("_best.try") > -2, found)).drop("_best")
