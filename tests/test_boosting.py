"""Boosted trees grown side by side are the library's, in passes that don't grow with the classes."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowquarry.operators import boosting as B
from flowquarry.operators import models as M
from flowquarry.operators.profiles import balanced_weight

FEATURES = ["shifted", "whole", "zeros", "same", "signed"]


def rows_of(spark, n, seed, classes):
    """Classes of unequal size; features with ties, zeros, one value and both signs."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(classes, n, p=np.arange(1, len(classes) + 1) / sum(range(1, len(classes) + 1)))
    place = np.searchsorted(classes, kind)
    data = {
        "kind": kind,
        "shifted": rng.normal(0, 1, n) + place * 0.7,
        "whole": rng.integers(0, 50, n) + (place == 1) * 20.0,
        "zeros": np.where(rng.random(n) < 0.7, 0.0, rng.normal(0, 1, n) + (place == 0)),
        "same": np.ones(n),
        "signed": rng.choice([-1.0, 0.0, 0.5], n),
        "val": rng.random(n) < 0.25,
    }
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(3, "shifted").cache()
    return df.filter("not val"), df.filter("val")


TWINS = re.compile(r"( *)If [^\n]*\n *Predict: (\S+)\n *Else [^\n]*\n *Predict: \2\n")


def tree_text(model):
    """Tests and predictions of every tree, less the last digits. Rounding alone may part a
    node whose rows are alike, into leaves of one prediction: those count as one leaf."""
    found = []
    for tree in model.trees:
        text = re.sub(r"Predict: (\S+)", lambda m: f"Predict: {float(m[1]):.9g}", tree.toDebugString.split("\n", 1)[1])
        while TWINS.search(text):
            text = TWINS.sub(r"\1Predict: \2\n", text)
        found.append(text)
    return found


@pytest.mark.parametrize(("n", "rounds", "tolerance"), [(900, 5, 0.001), (30_000, 4, 0.001), (600, 6, 0.05)])
def test_trees_are_the_librarys(spark, n, rounds, tolerance):
    train, val = rows_of(spark, n, n, ["a", "b", "c"])
    model = M.train_boosted(train, val, "kind", FEATURES, rounds=rounds, tolerance=tolerance)
    counts = M.class_counts(train, "kind")
    weights = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, balanced_weight(sum(counts.values()), 3, m))])
    both = train.unionByName(val).withColumn("w", F.element_at(weights, F.col("kind")))
    both = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both)
    for c, found in zip("abc", model.models):
        booster = GBTClassifier(labelCol="y", weightCol="w", validationIndicatorCol="val", validationTol=tolerance, maxIter=rounds, maxDepth=3, stepSize=0.3, seed=42)
        wanted = booster.fit(both.withColumn("y", (F.col("kind") == c).cast("double")))
        assert tree_text(found) == tree_text(wanted) and found.treeWeights == wanted.treeWeights
        assert found.numFeatures == wanted.numFeatures == len(FEATURES)


@pytest.mark.parametrize("classes", [["a", "b"], ["a", "b", "c", "d", "e"]])
def test_one_pass_grows_a_level_of_all_classes(spark, monkeypatch, classes):
    train, val = rows_of(spark, 800, 3, classes)
    passes = []
    monkeypatch.setattr(B, "_sums", lambda *a, f=B._sums: passes.append(1) or f(*a))
    monkeypatch.setattr(GBTClassifier, "fit", lambda *a: pytest.fail("one booster a class"))
    model = M.train_boosted(train, val, "kind", FEATURES, rounds=3, depth=2)
    assert len(model.models) == len(classes) and 2 <= len(passes) <= 3 * 2


def test_blocks_of_any_size_hold_the_same_rows(spark, monkeypatch):
    train, _ = rows_of(spark, 500, 5, ["a", "b"])
    rows = train.withColumn("code", (F.col("kind") == "b").cast("int"))
    cuts = [[0.0, 0.5], [10.0], [0.0], [], [-0.5, 0.25]]
    seen = {}
    for size in (50, 1 << 16):
        monkeypatch.setattr(B, "BLOCK_ROWS", size)
        held = B.blocks(rows, FEATURES, "code", cuts).collect()
        seen[size] = sorted(x for r in held for x in zip(np.frombuffer(r.codes, np.uint16), *np.frombuffer(r.bins, np.uint8).reshape(5, -1)))
    want = sorted((r.code, *(int(np.searchsorted(c, r[f])) for f, c in zip(FEATURES, cuts))) for r in rows.collect())
    assert [tuple(map(int, x)) for x in seen[50]] == [tuple(map(int, x)) for x in seen[1 << 16]] == want


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_a_value_that_is_no_number_is_an_error(spark, bad):
    rows = [(("x", "y")[i % 2], float(i)) for i in range(20)]
    train = spark.createDataFrame([*rows, ("x", bad)], "kind string, a double")
    with pytest.raises(Exception, match="null, NaN or infinite"):
        M.train_boosted(train, spark.createDataFrame(rows, "kind string, a double"), "kind", ["a"], rounds=2)
