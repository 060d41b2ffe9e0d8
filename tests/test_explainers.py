"""Kernel and partition explainers and anchors against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from flowquarry.operators import anchors as A
from flowquarry.operators import shapley as K

FEATURES = ["a", "b", "c", "d"]


def make_score():
    """A score without structure: every feature meets every other. Made here, it travels to the tasks by value."""

    def score(rows):
        return np.tanh(rows.sum(1)) + rows[:, 0] * rows[:, -1] - np.abs(rows).max(1)

    return score


tangled = make_score()


def brute_value(row, background, held, score=tangled):
    mixed = background.copy()
    mixed[:, list(held)] = row[list(held)]
    return float(score(mixed).mean())


def over_orders(row, background, orders):
    phi = np.zeros(len(row))
    for order in orders:
        for step, i in enumerate(order):
            before = brute_value(row, background, order[:step])
            phi[i] += (brute_value(row, background, order[: step + 1]) - before) / len(orders)
    return phi


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return rng.normal(0, 2, (12, 4)), rng.normal(0, 1, (7, 4))


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, *map(float, r)) for i, r in enumerate(points[0])]
    return spark.createDataFrame([*rows, (90, None, 1.0, 1.0, 1.0), (91, float("nan"), 1.0, 1.0, 1.0)], "id int, a double, b double, c double, d double")


def test_kernel_explainer_is_exact_on_all_coalitions(table, points):
    got = {(r.id, r.part): r.phi for r in K.kernel_shapley(table, "id", FEATURES, points[1], tangled).collect()}
    for i, row in enumerate(points[0]):
        want = over_orders(row, points[1], list(itertools.permutations(range(4))))
        assert [got[i, f] for f in FEATURES] == pytest.approx(want.tolist(), abs=1e-9)
    assert all(got[i, f] is None for i in (90, 91) for f in FEATURES)


def test_kernel_explainer_of_39_features():
    """With a drawn part: additive scores come out exactly, others add up."""
    rng = np.random.default_rng(1)
    rows, background, w = rng.normal(0, 1, (3, 39)), rng.normal(0, 1, (20, 39)), rng.normal(0, 1, 39)
    plan = K.kernel_plan(39, 400)
    assert len(plan.masks) <= 402 and len({m.tobytes() for m in plan.masks}) == len(plan.masks)
    linear = K.coalition_values(rows, background, plan.masks, lambda x: x @ w) @ plan.matrix.T
    assert np.allclose(linear, w * (rows - background.mean(0)), atol=1e-8)
    phi = K.coalition_values(rows, background, plan.masks, tangled) @ plan.matrix.T
    gain = [brute_value(r, background, range(39)) - brute_value(r, background, []) for r in rows]
    assert np.allclose(phi.sum(1), gain, atol=1e-8)


def test_drawn_coalitions_come_near_the_exact_values(points):
    rng = np.random.default_rng(2)
    rows, background = rng.normal(0, 1, (4, 10)), rng.normal(0, 1, (5, 10))
    exact, drawn = (K.coalition_values(rows, background, p.masks, tangled) @ p.matrix.T for p in (K.kernel_plan(10, 1022), K.kernel_plan(10, 400)))
    assert np.abs(exact - drawn).max() < 0.15


def tree_orders(tree):
    if isinstance(tree, int):
        return [(tree,)]
    return [x for a in tree_orders(tree[0]) for b in tree_orders(tree[1]) for x in (a + b, b + a)]


@pytest.mark.parametrize("tree", [((0, 1), (2, 3)), (((0, 2), 1), 3), (0, (1, (2, 3)))])
def test_owen_values_are_the_mean_over_the_orders_of_the_tree(points, tree):
    plan = K.partition_plan(tree)
    phi = K.coalition_values(points[0], points[1], plan.masks, tangled) @ plan.matrix.T
    for row, got in zip(points[0], phi):
        assert got == pytest.approx(over_orders(row, points[1], tree_orders(tree)), abs=1e-9)


def test_owen_values_of_a_deep_tree_add_up():
    tree = 0
    for i in range(1, 25):
        tree = (tree, i)
    rng = np.random.default_rng(3)
    rows, background = rng.normal(0, 1, (2, 25)), rng.normal(0, 1, (4, 25))
    plan = K.partition_plan(tree, 300)
    assert len(plan.masks) <= 300
    phi = K.coalition_values(rows, background, plan.masks, tangled) @ plan.matrix.T
    assert phi.sum(1) == pytest.approx([brute_value(r, background, range(25)) - brute_value(r, background, []) for r in rows])


def test_correlation_tree():
    corr = np.eye(5)
    for a, b, c in ((0, 3, -0.9), (1, 4, 0.8), (0, 1, 0.5), (3, 4, 0.5), (0, 4, 0.45), (1, 3, 0.4), (2, 0, 0.1), (2, 1, float("nan"))):
        corr[a, b] = corr[b, a] = c
    assert K.correlation_tree(corr) == (((0, 3), (1, 4)), 2)


def test_partition_explainer_uses_the_tables_correlations(spark, points):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (40, 2))
    rows = np.column_stack([x[:, 0], x[:, 1], x[:, 1] + 0.1 * rng.normal(0, 1, 40), -x[:, 0] + 0.1 * rng.normal(0, 1, 40)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double")
    from flowquarry.operators.profiles import correlations

    got = {(r.id, r.part): r.phi for r in K.partition_shapley(df, "id", FEATURES, points[1], tangled, correlations(df, FEATURES)).collect()}
    for i in range(5):
        want = over_orders(rows[i], points[1], tree_orders(((0, 3), (1, 2))))
        assert [got[i, f] for f in FEATURES] == pytest.approx(want.tolist(), abs=1e-9)


def test_explainers_do_not_shuffle(table, points):
    phi = K.kernel_shapley(table, "id", FEATURES, points[1], tangled)
    assert "Exchange" not in phi._jdf.queryExecution().executedPlan().toString()


def test_background_rows_repeat_and_are_whole(table):
    one, two = (K.background_rows(table.repartition(n), "id", FEATURES, 5) for n in (1, 7))
    assert one.shape == (5, 4) and (one == two).all()
    assert K.background_rows(table, "id", FEATURES, 50).shape == (12, 4)


# --- anchors -------------------------------------------------------------------------


def brute_anchors(rows, features, label, edges, precision, beam, rounds, bins):
    def bin_of(f, v):
        lo, hi = edges[f]
        return None if v is None else max(0, min(bins - 1, math.floor((v - lo) / ((hi - lo) or 1.0) * bins)))

    held = [(r[label], [bin_of(f, r[f]) for f in features]) for r in rows]
    out = []
    for c in {l for l, _ in held if l is not None}:
        frontier = [()]
        for step in range(1, rounds + 1):
            grown = set()
            for rule in frontier:
                for _, b in held:
                    if all(b[f] == at for f, at in rule):
                        grown |= {tuple(sorted((*rule, (f, b[f])))) for f in range(len(features)) if b[f] is not None and f not in {x for x, _ in rule}}
            scored = []
            for rule in grown:
                match = [l for l, b in held if all(b[f] == at for f, at in rule)]
                scored.append((A.lower_bound(match.count(c), len(match)), len(match), rule, match.count(c) / len(match)))
            best = sorted((s for s in scored if s[0] < precision), key=lambda s: (-round(s[0], 9), -s[1], s[2]))[:beam]
            for low, n, rule, p in [s for s in scored if s[0] >= precision] + best:
                out.append((c, step, tuple(f"{features[f]}={at}" for f, at in rule), n, round(p, 9), round(low, 9), low >= precision))
            frontier = [s[2] for s in best]
    return sorted(out)


def test_anchors_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b, c = (rng.choice([None, *map(float, range(6))]) if rng.random() < 0.02 else float(rng.randrange(6)) for _ in range(3))
        label = "x" if a == 1 and b in (2, 3) else "y" if c == 5 and a != 1 else rng.choice(["x", "y", "z"]) if i % 3 else None
        rows.append({"a": a, "b": b, "c": c, "label": label})
    df = spark.createDataFrame(rows, "a double, b double, c double, label string")
    edges = {f: (0.0, 6.0) for f in "abc"}
    got = A.anchor_beam(df, list("abc"), edges, "label", 0.85, 3, 3, 6).collect()
    want = brute_anchors(rows, list("abc"), "label", edges, 0.85, 3, 3, 6)
    assert sorted((r.label, r["round"], tuple(r.rule), r.n, round(r.precision, 9), round(r.lower, 9), r.anchor) for r in got) == want
    found = {tuple(r.rule) for r in got if r.anchor and r.label == "x"}
    assert any(len(rule) == 2 and "a=1" in rule for rule in found)
    assert A.anchor_beam(df.limit(0), list("abc"), edges, "label").count() == 0


def test_bound_of_a_share():
    assert A.lower_bound(0, 10) == pytest.approx(0) and 0.7 < A.lower_bound(10, 10) < 0.8 and A.lower_bound(1000, 1000) > 0.99


def test_other_class_scores_coalitions_without_mixing_rows():
    import numpy as np

    from flowquarry.operators import profiles as P

    rng = np.random.default_rng(7)
    scaler = P.Scaler(list("abc"), [1.0, 2.0, 3.0], [0.5, 2.0, 0.0])
    model = P.PrototypeModel(scaler, ["Benign", "DDoS", "DoS"], rng.normal(size=(3, 3)).tolist())
    rows, background = rng.normal(size=(30, 3)), rng.normal(size=(8, 3))
    masks = np.array([[bool(m >> i & 1) for i in range(3)] for m in range(8)])

    class Unasked(P.OtherClass):
        def __call__(self, mixed):
            raise AssertionError("rows were mixed")

    plain = P.OtherClass(model, "Benign")
    got = K.coalition_values(rows, background, masks, Unasked(model, "Benign"))
    assert np.allclose(got, K.coalition_values(rows, background, masks, lambda mixed: plain(mixed)), rtol=0, atol=1e-12)
    # Rows and background rows too far out for a product of exponentials take the plain way.
    rows[3], rows[7, 1], background[2, 0] = 1e6, -1e9, 1e7
    got = K.coalition_values(rows, background, masks, plain)
    assert np.allclose(got, K.coalition_values(rows, background, masks, lambda mixed: plain(mixed)), rtol=0, atol=1e-12)
