"""The mix against a plain single-machine version."""

import hashlib
import re

import pytest

from flowquarry.llm import curriculum as m


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in fixed)
        level = (total - sum(3 * sizes[s] for s in fixed)) / rest if rest else 0
        more = {s for s in names if s not in fixed and 3 * sizes[s] < level * weight[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in fixed else level * weight[s] for s in names}
        fixed |= more


def check(df, **options):
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = brute_targets(sizes) if sizes else {}
    got = m.mix(df, **options).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.source_size) for r in got) == sorted((i or -1, size(t), sizes[s]) for i, t, s in rows)
    for s, target in targets.items():
        mine = [r for r in got if r.source_size == sizes[s] and r.target == pytest.approx(target)]
        assert mine
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    return rows, sizes, targets, got


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, sizes, targets, got = check(df)
    source = {i: s for i, _, s in rows}
    largest = max(r.size for r in got)
    for s, target in targets.items():
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - target) <= 3 * largest
    assert sorted(map(tuple, m.mix(df).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_small_sources_stop_at_the_bound(spark):
    words = lambda n: "w " * n
    rows = [(i, words(50), "big") for i in range(40)] + [(100, words(2), "a"), (101, words(3), None), (102, None, "nul"), (103, "", "nul"), (None, words(7), "c"), (100, words(2), "a"), (104, words(30000), "long")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, position string")
    _, sizes, targets, got = check(df)
    assert targets["a"] == 3.0 * sizes["a"] and sum(r.taken for r in got if r.source_size == 4) == 12
    kept = m.mixed_documents(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.copies for r in got)


def test_every_copy_has_its_own_time(spark):
    rows = [(100 * k + i, "w " * n, s) for k, (s, count, n) in enumerate([("a", 30, 20), ("b", 12, 10), ("c", 25, 8)]) for i in range(count)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    targets = brute_targets(sizes)
    assert targets["b"] > sizes["b"] and targets["c"] > 2 * sizes["c"]
    digest = lambda i, t: hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    want = []
    for s, (start, end) in zip("abc", ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))):
        before = 0
        for e in range(3):
            for h, i, n in sorted((digest(i, t), i, len(t.split())) for i, t, x in rows if x == s):
                if before + n / 2 < targets[s]:
                    share, slope = before / targets[s], end - start
                    want.append(((share if not slope else ((start * start + 2 * slope * share) ** 0.5 - start) / slope), h, i))
                before += n
    got = [r.doc_id for r in m.mixed_documents(df).collect()]
    assert got == [i for _, _, i in sorted(want)]
    # The last third of the run still holds the late source, and no copies stand side by side.
    assert max(p for p, _, i in want if i >= 200) > 0.95 and all(x != y for x, y in zip(got, got[1:]))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix(df).count() == 0 and m.mixed_documents(df).count() == 0
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in m.mix(none).collect()] == [0, 0]


def test_order_of_schedules():
    for start, end in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)):
        for share in (0.0, 0.25, 0.7, 1.0):
            slope, area = end - start, (start + end) / 2
            t = share if start == end else (((start * start) + 2 * slope * area * share) ** 0.5 - start) / slope
            assert start * t + slope * t * t / 2 == pytest.approx(area * share)
