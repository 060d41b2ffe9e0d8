"""Modes from bounded summaries against full counts."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from flowquarry.operators import heavy_hitters as H


def brute(values):
    counts = Counter("nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v for v in values if v is not None)
    if not counts:
        return None
    most = max(counts.values())
    return min((v for v, n in counts.items() if n == most), key=lambda v: (v == "nan", v) if not isinstance(v, str) or v == "nan" else (False, v))


def test_summary_bounds():
    rng = random.Random(1)
    for size in (3, 10, 50):
        summary, truth = H.Summary(size), Counter()
        for _ in range(20):
            part = [int(rng.paretovariate(0.7)) % 400 for _ in range(200)]
            truth.update(part)
            summary.add(pa.array([*map(float, part), None]))
            assert len(summary.counts) <= size
        assert summary.taken <= truth.total() / (size + 1)
        for value, n in truth.items():
            assert n - summary.taken <= summary.counts.get(float(value), 0) <= n


@pytest.mark.parametrize("size", [1024, 8, 1])
def test_modes(spark, monkeypatch, size):
    monkeypatch.setattr(H, "CANDIDATES", 6)
    rng = random.Random(size)
    rows = []
    for i in range(900):
        heavy = rng.choice([2.0, 7.5]) if rng.random() < 0.5 else float(rng.randrange(300))
        even = float(i % 450)
        text = rng.choice(["b", "a", f"t{rng.randrange(500)}"])
        odd = rng.choice([0.0, -0.0, float("nan"), None])
        rows.append((heavy, even, text, odd, None, "one", i % 3 if i % 7 else None, f"k{i // 3}"))
    df = spark.createDataFrame(rows, "heavy double, `e.v en` double, text string, odd double, none double, c string, n int, thrice string").repartition(5)
    kinds = {"heavy": "double", "e.v en": "double", "text": "string", "odd": "double", "none": "double", "c": "string", "n": "double", "thrice": "string"}
    got = H.modes(df, kinds, size)
    for at, name in enumerate(kinds):
        want = brute([r[at] if not isinstance(r[at], int) else float(r[at]) for r in rows])
        assert got[name] == want or (want == "nan" and math.isnan(got[name])), name
    assert H.modes(df.limit(0), kinds, size) == dict.fromkeys(kinds)


def test_rows_are_not_copied_per_column(spark):
    df = spark.createDataFrame([tuple(float(i % 4) for _ in range(39)) for i in range(40)], [f"f{i}" for i in range(39)])
    plan = H.summaries(df, ["double"] * 39)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    assert set(H.modes(df, {f"f{i}": "double" for i in range(39)}).values()) == {0.0}


def test_a_task_gives_up_on_even_values_only():
    even, uneven = H.Summary(4), H.Summary(4)
    for i in range(H.PATIENCE + 2):
        even.add(pa.array([float(50 * i + k) for k in range(50)]))
        uneven.add(pa.array([float(50 * i + k) for k in range(30)] + [-1.0] * 20))
    assert even.counts == {} and uneven.counts[-1.0] >= 20 * (H.PATIENCE + 2) - uneven.taken > 0
    before = even.taken
    even.add(pa.array([7.5] * 30 + [None]))
    # What may have been passed over covers any value's count.
    assert even.taken == before + 30
