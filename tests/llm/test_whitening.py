"""Whitening by block matrices against numpy on the whole table."""

import math

import numpy as np
import pytest

from flowquarry.llm import whitening as m

SCHEMA = "vec_id long, embedding array<float>, n long, component int"


def quantise(v):
    return tuple(math.floor(256 * float(c)) for c in v)


def sound(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def check(got, rows, components=4):
    """Everything a result promises, against dense numpy, for rows of one length."""
    good = [(i, quantise(v)) for i, v in rows if sound(v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, np.float64)
    values, vectors = np.linalg.eigh(np.cov(a.T, bias=True).reshape(a.shape[1], -1))
    order = np.argsort(-values)[:components]
    assert len(got) == len(good) * len(order)
    by_key = {}
    for r in got:
        by_key.setdefault((r.vec_id is None, r.vec_id, r.component), []).append(r)
    by_x = {}
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        centred = np.array([c - s / n for c, s in zip(x, sums)])
        for k, e in enumerate(order):
            mine = by_key[i is None, i, k + 1]
            assert all(r.n == n and abs(r.explained - values[e] / values.sum()) < 1e-9 and r.identity_error < 1e-6 for r in mine)
            want = centred @ vectors[:, e] / math.sqrt(values[e])
            near = [r for r in mine if r.deviation == deviation and abs(abs(r.whitened) - abs(want)) < 1e-6]
            assert near
            by_x.setdefault(k, []).append(near[0].whitened * want)
    for signs in by_x.values():  # the same sign for all rows
        assert all(s >= -1e-9 for s in signs) or all(s <= 1e-9 for s in signs)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], SCHEMA)


def vectors(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim)) * np.linspace(1, 3, dim)
    x[:, 0] += x[:, 1]
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize(("cells", "slab"), [(1 << 19, 65_536), (120, 65_536), (240, 2)])
def test_against_dense(spark, monkeypatch, cells, slab):
    monkeypatch.setattr(m, "CELLS", cells)
    monkeypatch.setattr(m, "SLAB", slab)
    rows = vectors(200, 6, 1)
    rows += [(900 + i, rows[3][1]) for i in range(50)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(800, None), (801, [None] * 6), (802, [float("nan")] * 6), (803, [float("inf")] + [0.0] * 5), (804, [])]
    check(m.whiten(frame(spark, rows)).collect(), rows)


def test_lengths_stand_alone(spark):
    long, short = vectors(40, 5, 2), [(500 + i, v) for i, v in vectors(30, 2, 3)]
    got = m.whiten(frame(spark, long + short)).collect()
    check([r for r in got if r.vec_id < 500], long)
    check([r for r in got if r.vec_id >= 500], short)


def test_without_variance(spark):
    one = m.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (i, c, 1, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)
    }
    flat = m.whiten(frame(spark, [(i, [float(i), 0.5, 0.5]) for i in range(9)])).collect()
    assert len(flat) == 27 and all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in flat)
    assert {round(r.explained, 9) for r in flat if r.component == 1} == {1.0} and {r.explained for r in flat if r.component > 1} == {0.0}


def test_nothing(spark):
    empty = m.whiten(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert m.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(m.op12_whitening(spark, "/root/testdata/sf0.01").collect(), rows)
