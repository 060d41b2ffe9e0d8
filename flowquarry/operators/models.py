"""Pipelines and classifiers from Spark ML, rules read from trees, and feature search."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.operators import boosting as B
from flowquarry.operators.profiles import balanced_weight
from flowquarry.operators.scoring import Rule, Test


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True) -> Pipeline:
    """Scaled (or passed-through) numbers and one-hot categories in ``features``; a
    category unknown to training is all zeros."""
    stages: list = []
    parts = []
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="error"))
        parts.append("_numbers")
        if scale:
            stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True))
            parts[-1] = "_scaled"
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The indexer's "keep" puts the unknown index last, and dropLast turns it into zeros.
        stages.append(OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", dropLast=True))
        parts.append(f"_h_{c}")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


CLASSIFIERS = {
    "logistic": lambda **kw: LogisticRegression(maxIter=40, weightCol="_weight", **kw),
    "forest": lambda **kw: RandomForestClassifier(numTrees=20, maxDepth=8, seed=42, weightCol="_weight", **kw),
    "tree": lambda **kw: DecisionTreeClassifier(maxDepth=8, seed=42, weightCol="_weight", **kw),
}


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, one counting pass; its keys in order are the classes of a model."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def with_class_weights(df: DataFrame, label: str, output: str = "_weight", counts: dict | None = None) -> DataFrame:
    """Balanced class weights as a literal map; one counting pass, unless ``counts`` are known."""
    counts = class_counts(df, label) if counts is None else counts
    n, k = sum(counts.values()), len(counts)
    pairs = [F.lit(x) for c, m in counts.items() for x in (c, balanced_weight(n, k, m))]
    return df.withColumn(output, F.element_at(F.create_map(*pairs), F.col(label)))


def with_class_index(df: DataFrame, label: str, counts: dict, output: str = "_label") -> tuple[DataFrame, list[str]]:
    """The class's place among the sorted classes, as a string indexer gives it, and the classes.

    A literal map is read instead of calling a function per row; a row without a class or of
    one not in ``counts`` is an error, as there.
    """
    classes = sorted(str(c) for c in counts if c is not None)
    if not classes:
        raise ValueError(f"no row has a class in {label!r}")
    places = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    place = F.try_element_at(places, F.col(label).cast("string"))
    unknown = F.raise_error(F.concat(F.lit(f"not a class in {label}: "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    nominal = {"ml_attr": {"type": "nominal", "name": output, "vals": classes}}
    return df.withColumn(output, F.coalesce(place, unknown.cast("double")).alias(output, metadata=nominal)), classes


def _assembled(df: DataFrame, numeric: Sequence[str], scaler) -> DataFrame:
    """``features`` as the fitted ``scaler`` makes them of ``numeric``: scaled in plain columns,
    then put into a vector once. Training reads a row several times."""
    scale = [1 / s if s else 0.0 for s in scaler.std.toArray().tolist()]
    names = [f"_s{i}" for i in range(len(numeric))]
    scaled = [((quoted(f).cast("double") - F.lit(m)) * F.lit(s)).alias(n) for n, f, m, s in zip(names, numeric, scaler.mean.toArray().tolist(), scale)]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(df.select("_label", "_weight", *scaled))


def train_classifier(
    train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "logistic", counts: dict | None = None
) -> PipelineModel:
    """Class-weighted fit; the model adds ``predicted``, ``confidence`` and the class
    ``probabilities`` through :func:`score`. ``counts`` are the rows per class, where known."""
    counts = class_counts(train, label) if counts is None else counts
    prepared, classes = with_class_index(with_class_weights(train, label, counts=counts), label, counts)
    pipeline = feature_pipeline(numeric, categorical).fit(prepared)
    if numeric and not categorical:
        ready = _assembled(prepared, numeric, pipeline.stages[1])
    else:
        ready = pipeline.transform(prepared)
    model = CLASSIFIERS[kind](featuresCol="features", labelCol="_label").fit(ready)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=classes)
    return PipelineModel(stages=[pipeline, model, names])


def choose_classifier(
    train: DataFrame, val: DataFrame, label: str, numeric: Sequence[str], kinds: Sequence[str] = ("logistic", "tree")
) -> tuple[PipelineModel, str, float]:
    """The model of the kind with the best balanced accuracy on ``val``, its kind and that
    accuracy; the kind named first wins a tie."""
    best = None
    counts = class_counts(train, label)
    for kind in kinds:
        model = train_classifier(train, label, numeric, kind=kind, counts=counts)
        reached = mean_recall(score(model, val), label)
        if best is None or reached > best[2]:
            best = model, kind, reached
    return best


def mean_recall(scored: DataFrame, label: str) -> float:
    """Balanced accuracy: the mean over classes of the share predicted right."""
    right = (F.col("predicted") == F.col(label)).cast("double")
    return scored.groupBy(label).agg(F.avg(right).alias("recall")).agg(F.coalesce(F.avg("recall"), F.lit(0.0))).first()[0]


def train_perceptron(train: DataFrame, label: str, numeric: Sequence[str], hidden: Sequence[int] = (16,)) -> PipelineModel:
    """Small feed-forward net. It takes no weights: balance the classes beforehand."""
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    layers = [len(numeric), *hidden, len(indexer.labels)]
    net = MultilayerPerceptronClassifier(layers=layers, labelCol="_label", featuresCol="features", seed=42, maxIter=60)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return Pipeline(stages=[feature_pipeline(numeric), net, names]).fit(indexer.transform(train))


@dataclass(frozen=True)
class BoostedClassifier:
    """Boosted trees of each class against the rest; ``rounds`` trees of each are used."""

    classes: list[str]
    pipeline: PipelineModel
    models: list
    rounds: int
    #: Balanced accuracy on the validation rows after each round.
    watched: list[float]

    def margins(self, df: DataFrame, rounds: int) -> DataFrame:
        """Adds the features and ``_m<class>_<round>``: every class's margin after each round.

        Every tree is one expression over the row, so all rounds take one pass.
        """
        df = self.pipeline.transform(df)
        for c, model in enumerate(self.models):
            for i, tree in enumerate(model.trees[:rounds]):
                df = tree.setFeaturesCol("features").setPredictionCol(f"_t{c}_{i}").transform(df)
        for i in range(rounds):
            step = {}
            for c, model in enumerate(self.models):
                before = F.col(f"_m{c}_{i - 1}") if i else F.lit(0.0)
                own = F.col(f"_t{c}_{i}") * F.lit(model.treeWeights[i]) if i < len(model.trees) else F.lit(0.0)
                step[f"_m{c}_{i}"] = before + own
            df = df.withColumns(step)
        return df

    def winner(self, after: int) -> Column:
        """The class of the highest margin after a round (from 0), the first one on ties."""
        margins = F.array(*[F.col(f"_m{c}_{after}") for c in range(len(self.classes))])
        return F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position(margins, F.array_max(margins)).cast("int"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted``, ``probabilities`` in the order of ``classes`` and ``confidence``."""
        last = self.rounds - 1
        odds = [1 / (1 + F.exp(-2 * F.col(f"_m{c}_{last}"))) for c in range(len(self.classes))]
        scored = self.margins(df, self.rounds).withColumn("predicted", self.winner(last)).withColumn("_p", F.array(*odds))
        total = F.aggregate("_p", F.lit(0.0), lambda a, b: a + b)
        scored = scored.withColumn("probabilities", F.transform("_p", lambda p: p / total)).withColumn("confidence", F.array_max("probabilities"))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], "predicted", "probabilities", "confidence")


def train_boosted(
    train: DataFrame, val: DataFrame, label: str, numeric: Sequence[str], rounds: int = 10, depth: int = 3, tolerance: float = 0.001
) -> BoostedClassifier:
    """Boosted trees of each class against the rest, watched on ``val``.

    Each class stops by its own loss on the validation rows; of the rounds left, all classes
    use as many as give the best balanced accuracy there, the fewest on ties. Classes weigh the same. Rows
    without a class take no part; a class met only in ``val`` counts as never found.
    """
    train, val = train.filter(F.col(label).isNotNull()), val.filter(F.col(label).isNotNull())
    counts = class_counts(train, label)
    classes = sorted(counts)
    weights = [balanced_weight(sum(counts.values()), len(classes), counts[c]) for c in classes]
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    pipeline = feature_pipeline(numeric, scale=False).fit(train)
    weighted = with_class_weights(train, label, counts=counts)
    cuts = B.feature_cuts(weighted, numeric, "_weight", sum(counts.values()), sum(w * counts[c] for w, c in zip(weights, classes)))
    known = (df.filter(F.col(label).isin(classes)).withColumn("_number", F.element_at(numbers, F.col(label))) for df in (train, val))
    held = [B.blocks(df, numeric, "_number", cuts).persist() for df in known]
    booster = GBTClassifier(
        labelCol="_is", weightCol="_weight", validationIndicatorCol="_watched", validationTol=tolerance, maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=42
    )
    try:
        grown = B.grow(*held, cuts, np.array(weights), rounds, depth, booster.getStepSize(), tolerance)
    finally:
        for df in held:
            df.unpersist()
    models = [B.library_model(train.sparkSession, trees, cuts, booster) for trees in grown]
    most = max(len(m.trees) for m in models)
    whole = BoostedClassifier(classes, pipeline, models, most, [])
    right = [F.avg((whole.winner(i) == F.col(label)).cast("double")).alias(f"r{i}") for i in range(most)]
    recalls = whole.margins(val, most).groupBy(label).agg(*right).collect()
    watched = [sum(r[f"r{i}"] for r in recalls) / len(recalls) if recalls else 0.0 for i in range(most)]
    best = max(range(most), key=lambda i: (round(watched[i], 12), -i))
    return BoostedClassifier(classes, pipeline, models, best + 1, watched)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch or stream: ``predicted``, ``confidence`` and ``probabilities``."""
    scored = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    inner = [c for c in scored.columns if c.startswith(("_i_", "_h_", "_numbers", "_scaled"))]
    return scored.withColumn("confidence", F.array_max("probabilities")).drop(
        "features", "rawPrediction", "probability", "prediction", *inner
    )


def fit_rule_tree(train: DataFrame, label: str, features: Sequence[str], depth: int = 5, min_split: int = 50):
    """A shallow tree and its class names; halves of a split hold half of ``min_split``."""
    indexed, classes = with_class_index(train, label, class_counts(train, label))
    prepared = VectorAssembler(inputCols=list(features), outputCol="features").transform(indexed)
    tree = DecisionTreeClassifier(
        labelCol="_label", featuresCol="features", maxDepth=depth, minInstancesPerNode=max(1, min_split // 2), seed=42
    )
    return tree.fit(prepared), classes


def majority_label(df: DataFrame, label: str) -> str:
    """Most frequent class, the first in order on ties: the default of a rule list."""
    return df.groupBy(label).count().orderBy(F.desc("count"), label).first()[0]


_TEST = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
_LEAF = re.compile(r"^( *)Predict: (\S+)$")


def extract_rules(model, features: Sequence[str], classes: Sequence[str]) -> list[Rule]:
    """Every root-to-leaf path as one rule, with its full list of tests."""
    path: list[tuple[int, Test]] = []
    rules = []
    for line in model.toDebugString.splitlines():
        test, leaf = _TEST.match(line), _LEAF.match(line)
        if test:
            depth = len(test.group(1))
            path = [p for p in path if p[0] < depth]
            path.append((depth, Test(features[int(test.group(3))], test.group(4) == "<=", float(test.group(5)))))
        elif leaf:
            depth = len(leaf.group(1))
            path = [p for p in path if p[0] < depth]
            rules.append(Rule(tuple(t for _, t in path), classes[int(float(leaf.group(2)))]))
    return rules


def tree_importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray()
    return sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda p: (-p[1], p[0]))


# Settings of the evolutionary feature search.
SEARCH = {"population": 20, "generations": 20, "crossover": 0.7, "mutation": 0.033, "tournament": 3, "preferred": 17, "size_cost": 0.02}


def subset_merit(mask: int, relevance: Sequence[float], overlap: Sequence[Sequence[float]]) -> float:
    """High where chosen features tell of the class and little of each other."""
    chosen = [i for i in range(len(relevance)) if mask >> i & 1]
    k = len(chosen)
    if not k:
        return 0.0
    told = sum(relevance[i] for i in chosen) / k
    pairs = [overlap[i][j] for a, i in enumerate(chosen) for j in chosen[a + 1 :]]
    shared = sum(pairs) / len(pairs) if pairs else 0.0
    return k * told / math.sqrt(k + k * (k - 1) * shared)


def ga_select(
    relevance: DataFrame, correlations: DataFrame, features: Sequence[str], seed: int = 42, size_cost: float = 0.0, finalists: int = 1
) -> list[tuple[list[str], float]]:
    """Feature subset by evolutionary search. Spark has reduced the data to one relevance
    per feature and one correlation per pair; the search sees only those numbers. Returns
    the ``finalists`` best (features, merit) met, best first, for :func:`held_out_choice`."""
    told = {r["feature"]: r["mi"] for r in relevance.collect()}
    weight = [math.sqrt(max(0.0, told.get(f, 0.0))) for f in features]
    place = {f: i for i, f in enumerate(features)}
    overlap = [[0.0] * len(features) for _ in features]
    for r in correlations.collect():
        i, j = place[r["a"]], place[r["b"]]
        value = abs(r["corr"]) if r["corr"] is not None and not math.isnan(r["corr"]) else 0.0
        overlap[i][j] = overlap[j][i] = value

    def fitness(mask: int) -> float:
        return subset_merit(mask, weight, overlap) - size_cost * abs(mask.bit_count() - SEARCH["preferred"])

    rng = random.Random(seed)
    n = len(features)
    people = [rng.randrange(1, 1 << n) for _ in range(SEARCH["population"])]
    met = set(people)
    for _ in range(SEARCH["generations"]):
        parents = [max(rng.sample(people, min(SEARCH["tournament"], len(people))), key=fitness) for _ in people]
        children = []
        for a, b in zip(parents[::2], parents[1::2]):
            if rng.random() < SEARCH["crossover"] and n > 1:
                lo, hi = sorted(rng.sample(range(n + 1), 2))
                middle = ((1 << hi) - 1) ^ ((1 << lo) - 1)
                a, b = (a & ~middle) | (b & middle), (b & ~middle) | (a & middle)
            children += [a, b]
        people = [
            c ^ sum(1 << i for i in range(n) if rng.random() < SEARCH["mutation"]) or 1 << rng.randrange(n) for c in children
        ]
        met.update(people)
    best = sorted(met, key=lambda mask: (-fitness(mask), mask))[:finalists]
    return [([f for i, f in enumerate(features) if mask >> i & 1], fitness(mask)) for mask in best]


def held_out_choice(
    train: DataFrame, val: DataFrame, label: str, subsets: Sequence[tuple[list[str], float]]
) -> tuple[list[str], float, PipelineModel]:
    """The subset whose tree has the best balanced accuracy on ``val``, its merit and tree."""
    best = None
    counts = class_counts(train, label)
    for chosen, merit in subsets:
        model = train_classifier(train, label, chosen, kind="tree", counts=counts)
        reached = mean_recall(score(model, val), label)
        if best is None or reached > best[0]:
            best = reached, chosen, merit, model
    return best[1:]
