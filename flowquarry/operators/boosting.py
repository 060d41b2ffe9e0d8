"""Boosted trees of every class against the rest, grown side by side from sums over binned features.

The trees are those of the library's booster (``GBTClassifier``: logistic loss, variance, at most
32 bins a feature, early stop on validation rows). That one prepares, holds and passes over all
rows once more for every class, a few objects a row. Here rows are binned once, into blocks of a byte a
feature, and one pass sums up a level of the trees of all classes; a pass leaves a few
numbers per class, node, feature and bin.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.session import fresh_path

# The library's bins and the rows it draws them from, with the seed it draws by
# where its own seed is 42; and rows of a block.
BINS, DRAWN, DRAW_SEED = 32, 10_000, 444206279
BLOCK_ROWS = 1 << 16
EPSILON = np.finfo(float).eps


@dataclass
class Tree:
    """Nodes in heap order, the root at 1. Bins above ``cut`` go right; a leaf has none, its rows all go left."""

    depth: int
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    #: Rows, weight, weighted sum and sum of squares of each node, and the gain of its split.
    stats: list = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def __post_init__(self):
        size = 1 << (self.depth + 1)
        self.feature, self.cut, self.stats, self.gain = [0] * size, [-1] * size, [None] * size, [-1.0] * size

    def splits(self, node: int) -> bool:
        return self.cut[node] >= 0

    def place(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Each row's node at ``level``, from 0; ``bins`` are rows of one feature each."""
        at = np.zeros(bins.shape[1], np.uint8 if level < 8 else np.int32)
        for k in range(level):
            right = np.zeros(len(at), bool)
            for i in range(1 << k):
                node = (1 << k) + i
                if self.splits(node):
                    right |= (at == i) & (bins[self.feature[node]] > self.cut[node])
            at = 2 * at + right
        return at

    def values(self) -> np.ndarray:
        """The value of every place at the lowest level; below a leaf, that of the leaf."""
        found = []
        for node in range(1 << self.depth, 2 << self.depth):
            while self.stats[node] is None:
                node //= 2
            found.append(mean(self.stats[node]))
        return np.array(found)


def mean(stats) -> float:
    return float(stats[2] / stats[1]) if stats[1] else 0.0


def variance(stats) -> np.ndarray:
    _, w, s, q = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (q - s * s / w) / w)


def margin(trees: Sequence[Tree], step: float, bins: np.ndarray) -> np.ndarray:
    """The sum of the trees; all but the first count ``step`` times."""
    total = np.zeros(bins.shape[1])
    for i, tree in enumerate(trees):
        total += (tree.values() * (step if i else 1.0))[tree.place(bins, tree.depth)]
    return total


def cuts_of(values: np.ndarray, weights: np.ndarray, expected: float) -> list[float]:
    """Cuts between the drawn values of a feature, as the library sets them.

    Values other than zero are counted; zeros are what is left of the ``expected`` weight.
    """
    other = values != 0
    seen, where = np.unique(values[other], return_inverse=True)
    share = np.bincount(where, weights=weights[other], minlength=len(seen))
    if not len(seen):
        return []
    missing = expected - share.sum()
    if missing > EPSILON * other.sum() * 100:
        at = int(np.searchsorted(seen, 0.0))
        seen, share = np.insert(seen, at, 0.0), np.insert(share, at, missing)
    middles = (seen[:-1] + seen[1:]) / 2
    if len(middles) < BINS:
        return middles.tolist()
    stride = expected / BINS
    found, current, target = [], share[0], stride
    for i in range(1, len(seen)):
        before, current = current, current + share[i]
        if abs(before - target) < abs(current - target):
            found.append(float(middles[i - 1]))
            target += stride
    return found


def feature_cuts(train: DataFrame, numeric: Sequence[str], weight: str, rows: int, total: float) -> list[list[float]]:
    """About 31 cuts per feature at most, from the rows that the library would draw."""
    spark = train.sparkSession
    drawn = train.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)], F.col(weight).alias("w"))
    share = DRAWN / rows if rows > DRAWN else 1.0
    if share < 1:
        some = drawn._jdf.toJavaRDD().sample(False, share, DRAW_SEED)
        drawn = DataFrame(spark._jsparkSession.createDataFrame(some, drawn._jdf.schema()), spark)
    held = np.array([tuple(r) for r in drawn.collect()], dtype=float).reshape(-1, len(numeric) + 1)
    return [cuts_of(held[:, i], held[:, -1], share * total) for i in range(len(numeric))]


def blocks(df: DataFrame, numeric: Sequence[str], code: str, cuts: list[list[float]]) -> DataFrame:
    """Rows as blocks: their class numbers and, feature by feature, their bins."""
    held = [np.array(c) for c in cuts]
    kind = _kind(cuts)

    def block(parts: list) -> pa.RecordBatch:
        codes, *bins = (np.concatenate(p) for p in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, np.concatenate(bins) if bins else codes[:0])], names=["codes", "bins"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]
            for c, x in zip(numeric, columns):
                if not np.isfinite(x).all():
                    raise ValueError(f"{c} is null, NaN or infinite")
            parts.append([batch.column(0).to_numpy().astype(np.uint16), *[np.searchsorted(h, x).astype(kind) for h, x in zip(held, columns)]])
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(parts)
                parts, n = [], 0
        if n:
            yield block(parts)

    rows = df.select(F.col(code).cast("int").alias("code"), *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)])
    return rows.mapInArrow(run, "codes binary, bins binary")


def _kind(cuts: list[list[float]]) -> type:
    return np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16


def _unpacked(batches: Iterable[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for codes, bins in zip(*(batch.column(c).to_pylist() for c in ("codes", "bins"))):
            codes = np.frombuffer(codes, np.uint16)
            yield codes, np.frombuffer(bins, kind).reshape(-1, len(codes))


def _sums(held: DataFrame, cuts: list[list[float]], weights: np.ndarray, grown: dict[int, list[Tree]], growing: dict[int, Tree], level: int, step: float) -> np.ndarray:
    """Rows, weight, and weighted sum and squares of what the trees so far leave, by class
    growing, feature, node of the level and bin: one pass."""
    features, each, kind = len(cuts), max(map(len, cuts), default=0) + 1, _kind(cuts)
    wide = each << level
    shape = (len(growing), features, wide)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, *shape))
        for codes, bins in _unpacked(batches, kind):
            at, w = bins.astype(np.intp), weights[codes]
            for a, (c, tree) in enumerate(growing.items()):
                left = np.where(codes == c, 1.0, -1.0)
                if grown[c]:
                    left = 4 * left / (1 + np.exp(2 * left * margin(grown[c], step, bins)))
                first = tree.place(bins, level).astype(np.intp) * each
                s = w * left
                sums = (None, w, s, s * left)
                for f in range(features):
                    cell = first + at[f]
                    for k, x in enumerate(sums):
                        total[k, a, f] += np.bincount(cell, x, wide)
        total = total.reshape(4, -1)
        met = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int64)), *[pa.array(x[met]) for x in total]], names=["cell", "n", "w", "s", "q"])

    sums = [F.sum(c) for c in ("n", "w", "s", "q")]
    total = np.zeros((4, int(np.prod(shape))))
    for cell, *x in held.mapInArrow(run, "cell long, n double, w double, s double, q double").groupBy("cell").agg(*sums).collect():
        total[:, cell] = x
    return total.reshape(4, len(growing), features, 1 << level, each)


def _losses(held: DataFrame, cuts: list[list[float]], weights: np.ndarray, grown: dict[int, list[Tree]], step: float) -> dict[int, float]:
    """The weighted mean loss of every class's trees."""
    kind = _kind(cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(grown), 2))
        for codes, bins in _unpacked(batches, kind):
            w = weights[codes]
            for a, (c, trees) in enumerate(grown.items()):
                own = np.where(codes == c, 1.0, -1.0)
                total[a] += (w * 2 * np.logaddexp(0, -2 * own * margin(trees, step, bins))).sum(), w.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(grown), pa.int64()), *[pa.array(x) for x in total.T]], names=["c", "loss", "w"])

    found = {c: (x, w) for c, x, w in held.mapInArrow(run, "c long, loss double, w double").groupBy("c").agg(F.sum("loss"), F.sum("w")).collect()}
    return {c: found[c][0] / found[c][1] if found.get(c, (0, 0))[1] else float("nan") for c in grown}


def _split(tree: Tree, node: int, sums: np.ndarray, cuts: list[list[float]], children_are_leaves: bool) -> list[int]:
    """The best split of a node from its sums by feature and bin; its children that may split."""
    best = None
    for f, c in enumerate(cuts):
        if not c:
            continue
        run = np.cumsum(sums[:, f, : len(c) + 1], axis=1)
        whole, left = run[:, -1], run[:, :-1]
        right = whole[:, None] - left
        gain = variance(whole) - left[1] / whole[1] * variance(left) - right[1] / whole[1] * variance(right)
        gain = np.where((left[0] < 1) | (right[0] < 1) | (gain < 0), -np.inf, gain)
        cut = int(np.argmax(gain))
        if best is None or gain[cut] > best[0]:
            best = float(gain[cut]), f, cut, left[:, cut], right[:, cut]
    if best is None or best[0] <= 0:
        return []
    tree.gain[node], tree.feature[node], tree.cut[node], tree.stats[2 * node], tree.stats[2 * node + 1] = best
    return [] if children_are_leaves else [child for child in (2 * node, 2 * node + 1) if abs(variance(tree.stats[child])) >= EPSILON]


def grow(train: DataFrame, val: DataFrame, cuts: list[list[float]], weights: np.ndarray, rounds: int, depth: int, step: float, tolerance: float) -> list[list[Tree]]:
    """The trees of every class. ``train`` and ``val`` are blocks, ``weights`` are by class; a
    class ends when its loss on ``val`` no longer falls by ``tolerance``, and keeps its best trees."""
    grown = {c: [] for c in range(len(weights))}
    best, kept, active = {}, {}, list(grown)
    for m in range(rounds):
        growing = {c: Tree(depth) for c in active}
        split = {c: [1] for c in active}
        for level in range(depth):
            growing_now = {c: t for c, t in growing.items() if split[c]}
            if not growing_now:
                break
            sums = _sums(train, cuts, weights, grown, growing_now, level, step)
            for a, (c, tree) in enumerate(growing_now.items()):
                if not level:
                    tree.stats[1] = sums[:, a, 0, 0].sum(axis=1) if cuts else np.zeros(4)
                split[c] = [child for node in split[c] for child in _split(tree, node, sums[:, a, :, node - (1 << level)], cuts, level + 1 == depth)]
        for c, tree in growing.items():
            grown[c].append(tree)
        losses = _losses(val, cuts, weights, {c: grown[c] for c in active}, step)
        for c in list(active):
            if not m:
                best[c], kept[c] = losses[c], 1
            elif best[c] - losses[c] < tolerance * max(losses[c], 0.01):
                active.remove(c)
            elif losses[c] < best[c]:
                best[c], kept[c] = losses[c], m + 1
        if not active:
            break
    return [trees[: kept[c]] for c, trees in grown.items()]


def library_model(spark: SparkSession, trees: list[Tree], cuts: list[list[float]], estimator: GBTClassifier) -> GBTClassificationModel:
    """The trees as the library's own model, through its model files."""
    step = estimator.getStepSize()
    nodes, single = [], []

    def put(i: int, tree: Tree, node: int) -> int:
        place = len(nodes) - starts[i]
        nodes.append(None)
        n, w, s, q = (float(x) for x in tree.stats[node])
        stats = float(mean((n, w, s, q))), float(variance((n, w, s, q))), [w, s, q], int(n)
        if tree.splits(node):
            f = tree.feature[node]
            under = put(i, tree, 2 * node), put(i, tree, 2 * node + 1)
            nodes[starts[i] + place] = (i, (place, *stats, tree.gain[node], *under, (f, [cuts[f][tree.cut[node]]], -1)))
        else:
            nodes[starts[i] + place] = (i, (place, *stats, -1.0, -1, -1, (-1, [], -1)))
        return place

    def described(name: str, uid: str, params: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": defaults, **more})

    defaults = {p.name: v for p, v in estimator._defaultParamMap.items() if p.name != "seed"}
    params = {p.name: v for p, v in estimator._paramMap.items()}
    own = {"featuresCol", "labelCol", "predictionCol", "leafCol", "maxDepth", "maxBins"}
    starts = []
    for i, tree in enumerate(trees):
        starts.append(len(nodes))
        put(i, tree, 1)
    whole = described("classification.GBTClassificationModel", f"{estimator.uid}_model", params, numFeatures=len(cuts), numTrees=len(trees))
    defaults = {k: v for k, v in defaults.items() if k in own}
    single = [(i, described("regression.DecisionTreeRegressionModel", f"{estimator.uid}_tree{i}", {}), step if i else 1.0) for i in range(len(trees))]
    path = fresh_path(spark, "boosted")
    kinds = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(nodes, kinds).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame(single, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return GBTClassificationModel.load(path)
