"""Exact top-k and the dimension scan against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import dimension_scan, histogram_topk

SCHEMA = "vec_id long, embedding array<float>, score string, id string"


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + copies] = x[0]
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "t") for i, v in rows], SCHEMA)


def brute_top(rows, step, k, scale=256):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % step == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, v in asked.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -t) for r, (t, j) in enumerate(s)]
    return sorted(out)


def odd_rows(x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [None] * x.shape[1]), (1002, [float("nan")] * x.shape[1]), (1003, [float("inf")] + [0.0] * (x.shape[1] - 1)), (None, x[1].tolist())]
    return rows + [(0, x[3].tolist()), (7, x[7].tolist())]


def test_top_k(spark, monkeypatch):
    for name, value in (("SLOT_ROWS", 40), ("BLOCK_QUERIES", 5)):
        monkeypatch.setattr(histogram_topk, name, value)
    rows = odd_rows(vectors(150, 6, 1, copies=60)) + [(2000, [0.5, 1.0]), (2010, [3e4, -2e4]), (2020, [])]
    got = histogram_topk.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)
    assert histogram_topk.top_k(frame(spark, []), F.col("vec_id") % 10 == 0, 5).count() == 0
    few = frame(spark, rows[:3])
    assert sorted(map(tuple, histogram_topk.top_k(few, F.col("vec_id") % 10 == 0, 5).collect())) == brute_top(rows[:3], 10, 5)


def test_top_k_of_large_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-3e6, 3e6) for _ in range(4)]) for i in range(60)]
    df = frame(spark, rows)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = histogram_topk.top_k(df, F.col("vec_id") % 20 == 0, 3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20, 3)


@pytest.mark.parametrize("size", [1e300, 1e8])
def test_scores_beyond_a_long_are_an_error(spark, size):
    wide = spark.createDataFrame([(i, [size, -size * (i + 1)]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 62 bits|does not fit a long"):
        histogram_topk.top_k(wide, F.col("vec_id") % 2 == 0, 2).collect()


def test_large_components_with_small_scores_are_exact(spark):
    rows = [(i, [float(2**50), float((-1) ** i * i)] if i % 2 else [0.0, float(2**50 * i)]) for i in range(8)]
    got = histogram_topk.top_k(spark.createDataFrame(rows[:1] + rows[1::2], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2, scale=1)
    assert sorted(map(tuple, got.collect())) == brute_top(rows[:1] + rows[1::2], 2, 2, 1)


def true_neighbours(ids, x, q, k):
    score = np.zeros(len(x))
    for c in range(x.shape[1]):
        score += x[:, c] * x[q, c]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_scan_is_exact_when_all_lists_are_probed(spark, monkeypatch):
    for name, value in (("PROBED", 1.0), ("EPSILON", 50.0), ("SLOT_ROWS", 60), ("BLOCK_QUERIES", 4)):
        monkeypatch.setattr(dimension_scan, name, value)
    x = vectors(300, 24, 2, copies=90)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 24), (901, None), (902, [float("nan")] * 24), (None, x[1].tolist()), (903, [1.0])]
    got = {}
    for r in sorted(dimension_scan.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, 7).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wide = x.astype(np.float64)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        assert found == true_neighbours(np.arange(300), wide, q, 7)


def test_scan_of_little(spark):
    assert dimension_scan.neighbours(frame(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(5, 8, 3))]
    got = dimension_scan.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and {r.vec_id for r in got} == {1, 2, 3, 4}


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    at = {int(i): n for n, i in enumerate(ids)}
    hits = total = 0
    found = {}
    for r in dimension_scan.op8_dimension_scan(spark, sf).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    for q, mine in found.items():
        want = true_neighbours(ids, x, at[q], 20)
        assert len(mine) == 20
        hits += sum(1 for j, s in want if mine.get(j) == s)
        total += len(want)
    assert hits / total >= 0.9
