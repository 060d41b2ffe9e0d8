"""Neighbours, resampling, explanations and models against brute force and invariants."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import balance as B
from flowquarry.operators import explain as X
from flowquarry.operators import models as M
from flowquarry.operators import profiles as P
from flowquarry.operators.neighbours import nearest
from flowquarry.operators.scoring import Rule, Test, apply_rules
from flowquarry.sources import sinks


@pytest.fixture(scope="module")
def points(spark):
    """Two clumps, one dense and repeated; the class 'big' holds most rows."""
    rng = np.random.default_rng(3)
    n = 600
    x = np.where(rng.random((n, 1)) < 0.5, rng.normal(0, 0.01, (n, 3)), rng.normal(5, 2, (n, 3)))
    x[:20] = x[0]
    kind = np.where(np.arange(n) % 10 == 0, "small", "big")
    pdf = pd.DataFrame({"id": np.arange(n), "kind": kind, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("tile,chunk", [(4096, 4096), (16, 32)])
def test_neighbours_match_brute_force(points, tile, chunk):
    pdf, df = points
    v = df.select("id", F.col("kind").alias("block"), F.array("a", "b", "c").alias("vec"))
    got = nearest(v, v, 4, True, tile, chunk).toPandas().sort_values(["qid", "position"]).groupby("qid")["pid"].apply(list)
    for kind, part in pdf.groupby("kind"):
        x, ids = part[["a", "b", "c"]].to_numpy(), part["id"].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        for i, row in zip(ids, d):
            assert got[i] == list(ids[np.lexsort((ids, np.round(row, 12)))[:4]])


def test_smote_counts_and_convexity(points):
    pdf, df = points
    rows = B.smote(df, "id", "kind", ["a", "b", "c"]).toPandas()
    counts = pdf["kind"].value_counts()
    assert len(rows) == counts["big"] - counts["small"] and set(rows["kind"]) == {"small"}
    assert not rows.duplicated(["seed", "copy"]).any()
    own = pdf.set_index("id")
    for r in rows.itertuples():
        s, t = own.loc[r.seed], own.loc[r.neighbour]
        assert s["kind"] == t["kind"] == "small" and 0 <= r.u < 1
        assert r.a == pytest.approx(s["a"] + r.u * (t["a"] - s["a"]))
    assert rows.groupby("seed").size().max() - rows.groupby("seed").size().min() <= 1


def test_soft_targets_and_single_rows(spark):
    assert B.soft_targets({"a": 100, "b": 24, "c": 25}) == {"b": 25}
    df = spark.createDataFrame([(1, "x", 0.0), (2, "x", 1.0), (3, "y", 5.0)], "id long, kind string, a double")
    assert B.smote(df, "id", "kind", ["a"]).count() == 0


def test_smote_nc_takes_the_majority_category(spark):
    rows = [(i, "big", float(i), "p") for i in range(12)] + [(100 + i, "rare", float(i), "q" if i < 5 else "r") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, kind string, a double, cat string")
    out = B.smote_nc(df, "id", "kind", ["a"], {"cat": ["p", "q", "r"]}).collect()
    assert len(out) == 6 and {r["cat"] for r in out} <= {"q", "r"}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        label = ["Benign", "DDoS", "DoS"][i % 3]
        centre = {"Benign": 0.0, "DDoS": 4.0, "DoS": -4.0}[label]
        rows.append((str(i), label, *(float(v) for v in rng.normal(centre, 1.0, 3))))
    return spark.createDataFrame(rows, "key string, label string, a double, b double, c double").cache()


def test_linear_attributions_add_up(scored):
    model = X.fit_linear(scored, ["a", "b", "c"])
    r = X.force_record(model)
    for row in scored.select(r.alias("r")).limit(50).collect():
        total = sum(e["phi"] for e in row["r"]["features"])
        assert row["r"]["final_value"] == pytest.approx(row["r"]["base_value"] + total)


@pytest.mark.parametrize("groups", [None, [["a", "b"], ["c"]]])
def test_shapley_efficiency(scored, groups):
    features = ["a", "b", "c"]
    model = P.fit_prototypes(scored, features)
    background = {f: 0.0 for f in features}

    def score(df):
        return model.transform(df).withColumn("score", F.col("probabilities")[0])

    phi = X.sampled_shapley(scored, "key", features, background, score, 3, groups)
    sums = {r["key"]: r["s"] for r in phi.groupBy("key").agg(F.sum("phi").alias("s")).collect()}
    at_zero = score(scored.limit(1).withColumns({f: F.lit(0.0) for f in features})).first()["score"]
    for r in score(scored).select("key", "score").collect():
        assert sums[r["key"]] == pytest.approx(r["score"] - at_zero, abs=1e-9)


@pytest.mark.parametrize("groups", [None, [["a", "c"], ["b"]]])
def test_exact_shapley_is_the_mean_over_all_orders(scored, groups):
    features = ["a", "b", "c"]
    model = P.fit_prototypes(scored, features)
    background = {"a": 0.5, "b": -1.0, "c": 2.0}
    phi = X.exact_shapley(scored, "key", features, background, lambda rows: model.probability(rows, "Benign"), groups)
    got = {(r["key"], r["part"]): r["phi"] for r in phi.collect()}
    parts = groups or [[f] for f in features]
    probability = lambda row: float(model.probability(np.array([[row[f] for f in features]]), "Benign")[0])
    for row in scored.select("key", *features).limit(20).collect():
        expected = dict.fromkeys(range(len(parts)), 0.0)
        orders = list(itertools.permutations(range(len(parts))))
        for order in orders:
            mixed = dict(background)
            for i in order:
                before = probability(mixed)
                mixed |= {f: row[f] for f in parts[i]}
                expected[i] += (probability(mixed) - before) / len(orders)
        for i, g in enumerate(parts):
            assert got[row["key"], "+".join(g)] == pytest.approx(expected[i], abs=1e-9)


def test_one_row_explanations_do_not_shuffle(scored):
    features = ["a", "b", "c"]
    model = P.fit_prototypes(scored, features)
    phi = X.exact_shapley(scored, "key", features, dict.fromkeys(features, 0.0), lambda rows: model.probability(rows, "Benign"))
    found = X.random_counterfactuals(scored, "key", model)
    own = scored._jdf.queryExecution().executedPlan().toString().count("Exchange")
    for df in (phi, found):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == own


def test_counterfactuals_really_are_benign(scored):
    features = ["a", "b", "c"]
    model = P.fit_prototypes(scored, features)
    attacks = model.transform(scored).filter("predicted <> 'Benign'").drop("distances", "probabilities", "distance", "confidence")
    found = X.random_counterfactuals(attacks, "key", model, tries=32)
    assert found.count() == attacks.count()
    assert found.filter("counterfactual is null").count() == 0
    moved = found.select("key", "label", *[F.col(f"counterfactual.{f}").alias(f) for f in features])
    assert moved.count() > 0
    assert {r["predicted"] for r in model.transform(moved).collect()} == {"Benign"}


def test_deviation_fallbacks(spark):
    df = spark.createDataFrame([("Benign", 1.0, 0.0), ("Benign", 1.0, 0.0), ("DDoS", 9.0, 7.0)], "label string, a double, b double")
    base = X.fit_baseline(df, ["a", "b"], {"a": 1, "b": 2})
    rows = X.baseline_deviation(df, base).select("label", "critical", *X.dual_messages(F.lit(None).cast("string")).values()).collect()
    assert rows[0]["critical"] is None and rows[0][2:] == X.NO_ANOMALY
    hit = rows[2]["critical"]
    # b has mean zero and is skipped; a is constant in Benign traffic, so it has no z.
    assert hit["feature"] == "a" and hit["z"] is None and "ekstremdir" in rows[2][2] and "8x" not in rows[2][2][:5]


def test_models_beat_the_majority_and_round_trip(spark, scored, tmp_path):
    model = M.train_classifier(scored, "label", ["a", "b", "c"])
    right = M.score(model, scored).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.8
    sinks.save_model(model, ["a", "b", "c"], ["Benign", "DDoS", "DoS"], str(tmp_path / "m"))
    again, features, classes = sinks.load_model(spark, str(tmp_path / "m"))
    assert features == ["a", "b", "c"] and classes[0] == "Benign"
    a = M.score(model, scored).select("key", "confidence").orderBy("key").collect()
    assert a == M.score(again, scored).select("key", "confidence").orderBy("key").collect()


def test_choice_by_held_out_rows(scored):
    train, val = scored.filter("key % 2 = 0"), scored.filter("key % 2 = 1")
    model, kind, reached = M.choose_classifier(train, val, "label", ["a", "b", "c"], kinds=("logistic", "tree"))
    single = {k: M.mean_recall(M.score(M.train_classifier(train, "label", ["a", "b", "c"], kind=k), val), "label") for k in ("logistic", "tree")}
    assert reached == pytest.approx(max(single.values())) == pytest.approx(single[kind])
    assert M.mean_recall(M.score(model, val), "label") == pytest.approx(reached)
    told, overlap = P.mutual_information(train, ["a", "b", "c"]), P.correlations(train, ["a", "b", "c"])
    finalists = M.ga_select(told, overlap, ["a", "b", "c"], finalists=3)
    assert len(finalists) == 3 and finalists[0][1] >= finalists[1][1] >= finalists[2][1]
    chosen, _, tree = M.held_out_choice(train, val, "label", finalists)
    trees = [M.mean_recall(M.score(M.train_classifier(train, "label", f, kind="tree"), val), "label") for f, _ in finalists]
    assert M.mean_recall(M.score(tree, val), "label") == pytest.approx(max(trees))
    assert chosen in [f for f, _ in finalists]


def test_perceptron_and_forest(scored):
    net = M.train_perceptron(scored, "label", ["a", "b", "c"], (6,))
    assert M.score(net, scored).filter("predicted = label").count() > 200
    forest = M.train_classifier(scored, "label", ["a", "b", "c"], kind="forest")
    assert M.score(forest, scored).filter("predicted = label").count() > 300


def test_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    fitted = M.feature_pipeline(["x"], ["c"]).fit(train)
    row = fitted.transform(spark.createDataFrame([("zz", 1.5)], "c string, x double")).first()
    assert list(row["features"].toArray()) == [0.0, 0.0, 0.0]


def test_rules_are_the_tree(spark, scored, tmp_path):
    tree, classes = M.fit_rule_tree(scored, "label", ["a", "b", "c"])
    rules = M.extract_rules(tree, ["a", "b", "c"], classes)
    assert len(rules) == (tree.numNodes + 1) // 2
    from pyspark.ml.feature import VectorAssembler

    ruled = apply_rules(scored, rules, "none", "by_rule")
    both = tree.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(ruled))
    names = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("prediction") + 1).cast("int"))
    assert both.filter(names != F.col("by_rule")).count() == 0
    sinks.write_rules(spark, rules, str(tmp_path / "rules"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rules")).collect()] == [r.text() for r in rules]


def test_search_finds_the_best_subset(scored):
    features = ["a", "b", "c"]
    told, overlap = P.mutual_information(scored, features), P.correlations(scored, features)
    ((_, merit),) = M.ga_select(told, overlap, features)
    weight = [next(r["mi"] for r in told.collect() if r["feature"] == f) ** 0.5 for f in features]
    table = [[0.0] * 3 for _ in features]
    for r in overlap.collect():
        i, j = features.index(r["a"]), features.index(r["b"])
        table[i][j] = table[j][i] = abs(r["corr"])
    assert merit == pytest.approx(max(M.subset_merit(m, weight, table) for m in range(1, 8)))


def test_correlated_groups(spark):
    df = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.2)], "a string, b string, corr double")
    assert X.correlated_groups(df, ["a", "b", "c"]) == [["a", "b"], ["c"]]


def test_shapley_groups_come_from_the_table(spark, monkeypatch):
    from flowquarry.plans import QUERIES, explaining

    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (60, 3))
    # Rate moves with IAT, against the named groups; the others move alone.
    rows = [(i, "Benign" if i % 2 else "DDoS", float(x + i % 2), float(y), float(-x - i % 2), float(z)) for i, (x, y, z) in enumerate(base)]
    flows = spark.createDataFrame(rows, "flow_id long, label string, Rate double, `Tot size` double, IAT double, Variance double")
    monkeypatch.setattr(explaining.S, "flows", lambda *a: flows)
    features, parts = explaining.SCORED, [["Rate", "IAT"], ["Tot size"], ["Variance"]]
    got = {(r["flow_id"], r["part"]): r["phi"] for r in QUERIES["correlated_shapley"](spark, "").collect()}
    assert len(got) == len(rows) * len(parts) and {p for _, p in got} == {"+".join(g) for g in parts}
    model = P.fit_prototypes(flows, features)
    background = {f: float(np.mean([r[2 + i] for r in rows if r[1] == "Benign"])) for i, f in enumerate(features)}
    score = lambda row: 1.0 - float(model.probability(np.array([[row[f] for f in features]]), "Benign")[0])
    for row in rows[:10]:
        for order in (orders := list(itertools.permutations(range(len(parts))))):
            mixed = dict(background)
            for i in order:
                before = score(mixed)
                mixed |= {f: row[2 + features.index(f)] for f in parts[i]}
                got[row[0], "+".join(parts[i])] -= (score(mixed) - before) / len(orders)
        assert all(got[row[0], "+".join(g)] == pytest.approx(0, abs=2e-6) for g in parts)


def test_far_outlier_is_scored(spark):
    rows = [(float(i % 10), "a" if i % 10 < 5 else "b") for i in range(10_000)] + [(1e9, "b")]
    df = spark.createDataFrame(rows, "x double, label string")
    model = P.fit_prototypes(df.filter("x < 100"), ["x"])
    out = model.transform(df).filter("x > 100").first()
    assert out["predicted"] == "b" and out["confidence"] == pytest.approx(1.0) and sum(out["probabilities"]) == pytest.approx(1.0)


def test_mutual_information_of_many_rows(spark, monkeypatch):
    n = 4_000_000_000
    counts = spark.createDataFrame([("f", 0, "a", n), ("f", 1, "b", n)], "feature string, bin int, label string, n long")
    monkeypatch.setattr(P, "binned_counts", lambda *a: counts)
    assert P.mutual_information(counts, ["f"]).first()["mi"] == pytest.approx(np.log(2))


def test_equal_points_give_k_rows_each(spark):
    df = spark.range(1500).select("id", F.lit("c").alias("block"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    got = nearest(df, df, 3, same_table=True)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["qid"], []).append((r["position"], r["pid"]))
    assert len(rows) == 1500 and all([p for _, p in sorted(v)] == [i for i in range(5) if i != q][:3] for q, v in rows.items())


@pytest.fixture(scope="module")
def separable(spark):
    """Three classes of unequal size, told apart by two of three features."""
    rng = np.random.default_rng(11)
    n = 3000
    kind = rng.choice(["few", "many", "some"], n, p=[0.05, 0.75, 0.2])
    a = rng.normal(0, 1, n) + np.where(kind == "few", 3.0, 0.0)
    b = rng.normal(0, 1, n) + np.where(kind == "some", 3.0, 0.0)
    pdf = pd.DataFrame({"id": np.arange(n), "kind": kind, "a": a, "b": b, "c": rng.normal(0, 1, n)})
    df = spark.createDataFrame(pdf)
    return df.filter("id % 3 = 0").cache(), df.filter("id % 3 = 1").cache(), df.filter("id % 3 = 2").cache()


def test_boosted_rounds_are_the_best_on_validation_rows(separable):
    train, val, test = separable
    model = M.train_boosted(train, val, "kind", ["a", "b", "c"], rounds=6)

    def recall(rows):
        rows = rows.select("kind", "predicted").toPandas()
        return (rows["kind"] == rows["predicted"]).groupby(rows["kind"]).mean().mean()

    by_round = []
    for m in range(1, len(model.watched) + 1):
        by_round.append(recall(M.BoostedClassifier(model.classes, model.pipeline, model.models, m, []).transform(val)))
    assert by_round == pytest.approx(model.watched)
    assert model.rounds == 1 + max(range(len(by_round)), key=lambda i: (round(by_round[i], 12), -i))
    scored = model.transform(test)
    assert scored.columns == [*test.columns, "predicted", "probabilities", "confidence"]
    assert recall(scored) > 0.8 and scored.count() == test.count()
    row = scored.first()
    assert sum(row.probabilities) == pytest.approx(1) and max(row.probabilities) == row.confidence


def test_boosted_margins_match_the_library(separable):
    train, val, _ = separable
    model = M.train_boosted(train, val, "kind", ["a", "b", "c"], rounds=3)
    most = min(len(m.trees) for m in model.models)
    rows = model.margins(val.limit(50), most)
    for c, booster in enumerate(model.models):
        if len(booster.trees) == most:
            raw = booster.setRawPredictionCol(f"raw{c}").setProbabilityCol(f"prob{c}").setPredictionCol(f"pred{c}").transform(rows)
            for r in raw.select(f"raw{c}", f"_m{c}_{most - 1}").collect():
                assert r[0][1] == pytest.approx(2 * r[1]) or r[0][1] == pytest.approx(r[1])


def test_boosted_odd_labels(spark):
    train = spark.createDataFrame([(i, "x" if i % 2 else "y", float(i % 2)) for i in range(40)] + [(99, None, 1.0)], "id long, kind string, a double")
    val = spark.createDataFrame([(1, "x", 1.0), (2, "y", 0.0), (3, "new", 1.0), (4, None, 0.0)], "id long, kind string, a double")
    model = M.train_boosted(train, val, "kind", ["a"], rounds=2)
    assert model.classes == ["x", "y"] and max(model.watched) == pytest.approx(2 / 3)
    assert {r.id: r.predicted for r in model.transform(val).collect()} == {1: "x", 2: "y", 3: "x", 4: "y"}


def test_quantile_bins(spark):
    rng = np.random.default_rng(5)
    v = np.exp(rng.normal(0, 4, 2000))
    rows = [("a" if x > 1 else "b", float(x), float(np.log(x)), 1.0, None if i % 5 else float("nan")) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "label string, skew double, log double, same double, gaps double")
    cuts = P.quantile_cuts(df, ["skew", "same"], 8)
    assert cuts["same"] == [1.0] and cuts["skew"] == sorted(v)[249:1999:250]
    counts = {(r.feature, r.bin): 0 for r in P.quantile_binned_counts(df, ["skew", "same", "gaps"], bins=8).collect()}
    for r in P.quantile_binned_counts(df, ["skew", "same", "gaps"], bins=8).collect():
        counts[r.feature, r.bin] += r.n
    assert counts == {**{("skew", i): 250 for i in range(8)}, ("same", 0): 2000, ("gaps", None): 2000}
    mi = {r.feature: r.mi for r in P.mutual_information(df, ["skew", "log", "same"], equal_counts=True).collect()}
    assert mi["skew"] == pytest.approx(mi["log"]) and mi["same"] == pytest.approx(0) and mi["skew"] > 0.6
    assert {r.feature: r.mi for r in P.mutual_information(df, ["skew"]).collect()}["skew"] < 0.1
    assert P.mutual_information(df.limit(0), ["skew"], equal_counts=True).count() == 0


def test_neighbour_visits_leave_a_task_in_small_batches(spark, monkeypatch):
    """A query visits up to all cells, so a whole Arrow batch's visits at once would be many times the batch."""
    from pyspark.sql.classic.dataframe import DataFrame

    plain = DataFrame.mapInPandas

    def watched(self, func, schema, *more):
        def run(batches):
            for out in func(batches):
                assert len(out) <= 4096
                yield out

        return plain(self, run, schema, *more)

    monkeypatch.setattr(DataFrame, "mapInPandas", watched)
    vec = F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).cast("double") for i in range(12)])
    points = spark.range(4000).coalesce(1).select("id", F.lit(0).alias("block"), vec.alias("vec"))
    found = nearest(points, points, 3, same_table=True)
    assert found.count() == 12000


def test_a_query_meets_few_points_of_a_tile(monkeypatch):
    """Exact with ties and repeated points, at a small part of all distances where there is structure."""
    from flowquarry.operators import neighbours as N

    rng = np.random.default_rng(7)
    points = np.concatenate([rng.integers(0, 200, (1500, 2)) / 4.0, np.repeat(rng.random((25, 2)) * 50, 20, axis=0)])
    flags = np.eye(5)[rng.integers(0, 5, len(points))] * 15
    points, ids = np.hstack([points, flags]), np.arange(len(points))
    compared, real = [], N._distances
    monkeypatch.setattr(N, "_distances", lambda a, b: (compared.append(len(a) * len(b)), real(a, b))[1])
    found = {i: [] for i in ids}
    for _, who, at, d in N.tile_search(ids, points, np.full(len(ids), np.inf), ids, points, 5, True):
        for q, p, x in zip(who.tolist(), at.tolist(), d.tolist()):
            found[q].append((x, p))
    assert sum(compared) < 0.25 * len(ids) ** 2
    whole = real(points, points)
    np.fill_diagonal(whole, np.inf)
    for q in ids:
        assert found[q] == [(whole[q, p], p) for p in np.lexsort((ids, whole[q]))[:5]]


def test_only_seeds_look_for_neighbours(spark):
    rows = [(i, "p", float(i % 7), float(i % 5)) for i in range(60)] + [(i, "q", float(i % 9), float(i % 4)) for i in range(60, 117)]
    df = spark.createDataFrame(rows, "id long, kind string, a double, b double")
    pairs, around = B.synthetic_pairs(df, "id", "kind", F.array("a", "b"), {"q": 60}, {"p": 60, "q": 57})
    seeds = {r.id for r in pairs.collect()}
    assert len(seeds) == 3 and {r.qid for r in around.collect()} == seeds


def test_rules_of_a_tree_test_each_node_once(spark):
    """The paths of a tree cost its nodes, not the sum of their lengths, and mean the same."""
    def paths(tests, depth):
        if not depth:
            return [Rule(tests, str(len(tests)) + "".join("l" if t.at_most else "r" for t in tests))]
        at = sum((4 if t.at_most else -4) * 0.5**i for i, t in enumerate(tests))
        return [r for low in (True, False) for r in paths((*tests, Test("ab"[depth % 2], low, at)), depth - 1)]

    rules = paths((), 5)
    odd = [None, float("nan"), float("inf"), float("-inf"), -3.0, 0.0, 0.25, 3.5]
    df = spark.createDataFrame([(x, y) for x in odd for y in odd], "a double, b double")
    ruled = apply_rules(df, rules, "none")
    shown = ruled._jdf.queryExecution().analyzed().toString()
    assert shown.count("<=") + shown.count(" > ") == 2 * (2**5 - 1)
    mixed = [Rule((Test("a", True, 0.0), Test("b", True, 0.0)), "x"), Rule((Test("a", True, 0.0), Test("b", True, 1.0)), "y"),
             Rule((Test("b", False, 0.0),), "z"), Rule((Test("a", True, 0.0),), "u"), Rule((), "rest"), Rule((Test("a", False, 0.0),), "never")]

    def holds(t, row):
        x = row[t.feature]
        if x is None:
            return False
        return (x <= t.threshold) if t.at_most else (x > t.threshold or x != x)  # Spark: NaN is above all numbers

    for given, default in ((rules, "none"), (mixed, "none"), (mixed[:4], "none"), ([], "none")):
        for row in apply_rules(df, given, default).collect():
            assert row.predicted == next((r.label for r in given if all(holds(t, row) for t in r.tests)), default)


def _watched(monkeypatch, kind, seen):
    """Learners of ``kind`` that also keep the rows they are handed."""
    make = M.CLASSIFIERS[kind]

    def spied(**settings):
        learner = make(**settings)
        fit = learner.fit
        learner.fit = lambda df: seen.append(df) or fit(df)
        return learner

    monkeypatch.setitem(M.CLASSIFIERS, kind, spied)


def _calls(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("UDF(")


@pytest.mark.parametrize("kind", ["tree", "logistic"])
def test_training_calls_one_function_per_row_and_learns_the_same(scored, monkeypatch, kind):
    """Class places, weights and scaling are plain columns; the model is the whole pipeline's own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer

    features, seen = ["a", "b", "c"], []
    index = StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc").fit(scored)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    stages = [M.feature_pipeline(features), M.CLASSIFIERS[kind](featuresCol="features", labelCol="_label"), names]
    plain = Pipeline(stages=stages).fit(index.transform(M.with_class_weights(scored, "label")))
    _watched(monkeypatch, kind, seen)
    model = M.train_classifier(scored, "label", features, kind=kind)
    assert _calls(seen[0]) == 1
    told = [M.score(m, scored).select("key", "predicted", "confidence").orderBy("key").collect() for m in (model, plain)]
    assert told[0] == told[1]


def test_rule_tree_reads_class_places_without_a_function(scored, monkeypatch):
    seen, make = [], M.DecisionTreeClassifier

    def spied(**settings):
        learner = make(**settings)
        fit = learner.fit
        learner.fit = lambda df: seen.append(df) or fit(df)
        return learner

    monkeypatch.setattr(M, "DecisionTreeClassifier", spied)
    _, classes = M.fit_rule_tree(scored, "label", ["a", "b", "c"])
    assert _calls(seen[0]) == 1 and classes == sorted(classes)


def test_finalists_share_the_count_of_classes(scored, monkeypatch):
    counted, count = [], M.class_counts
    monkeypatch.setattr(M, "class_counts", lambda df, label: counted.append(label) or count(df, label))
    M.held_out_choice(scored, scored, "label", [(["a"], 1.0), (["a", "b"], 0.5)])
    assert counted == ["label"]


def test_class_places(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    placed, classes = M.with_class_index(df, "k", M.class_counts(df, "k"))
    assert classes == ["a", "b", "c"] and {r["k"]: r["_label"] for r in placed.collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert placed.schema["_label"].metadata["ml_attr"]["vals"] == classes
    for odd in ("zz", None):
        with pytest.raises(Exception, match="not a class in k"):
            M.with_class_index(spark.createDataFrame([(odd,)], "k string"), "k", {"a": 1})[0].collect()
