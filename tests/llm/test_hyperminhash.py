"""HyperMinHash registers, estimates and components against brute force."""

import random
import re

import numpy as np
import pytest

from flowquarry.llm import hyperminhash as m


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    """(id, set size, component) of every row, all pairs compared."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)], rows[i][0] is not None and rows[i][0] == least[find(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", None, " \t\n\x0b\x0c\r", "One", "one  TWO", "a b c d", "Ünïcode ÀB c d e\x1cf g", "x y z " * 50, "w%d " * 9000])
def test_set_sizes(text):
    assert len(m.shingle_set(text)) == len(brute_set(text))


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    for size in (3, 12, 150, 4000):
        rate = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, size * 6 // 5 + 1, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[-size:])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            found = m.estimate(m.registers(a)[None], m.registers(b)[None], np.array([size]))[0]
            rate.append(found - j)
            assert abs(rate[-1]) < m.MARGIN
        assert abs(np.mean(rate)) < 0.03


def test_unrelated_registers_agree_by_chance():
    rng = np.random.default_rng(4)
    for size in (20, 3000):
        sketch = [m.registers(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(300)]
        seen = np.mean([(sketch[i] == sketch[j]).mean() for i in range(300) for j in range(i)])
        assert 0.5 < seen / m.chance(size.bit_length()) < 2


def test_leading_zeros_and_mantissa():
    values = np.array([1 << 63, (1 << 63) | (1 << 53), (1 << 62) | (1 << 61), (1 << 64) - 1, 1 << 11, 5], np.uint64)
    assert m.compressed(values).tolist() == [0, 1, 1024 + 512, 1023, 52 * 1024, 53 * 1024]


def family(rng, words, copies, most):
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(1000)}" for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(most + 1)):
            text[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        yield " ".join(text)


def expect(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, node int, label string")
    got = sorted(map(tuple, m.near_duplicates(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("crowd", [16, 3])
def test_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(m, "CROWD", crowd)
    rng = random.Random(crowd)
    texts = [t for words, copies in ((40, 60), (12, 40), (5, 30), (150, 90)) for t in family(rng, words, copies, max(1, words // 12))]
    texts += [None, "", "  ", "one", "ONE", "one two", "one two three", "one two three four", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = [(rng.choice([i, i, i, None, 7]), t) for i, t in enumerate(texts)]
    expect(spark, rows)


def test_chain_and_bounds(spark):
    """Similarity exactly at the bound links, just below does not, and links reach along a chain."""
    words = [f"w{i}" for i in range(200)]
    rows = [(10, " ".join(words[:7])), (11, " ".join(words[:8])), (20, " ".join(words[50:57])), (21, " ".join(words[50:56] + ["x"]))]
    rows += [(30 + s, " ".join(words[100 + 2 * s : 130 + 2 * s])) for s in range(12)]
    expect(spark, rows)
    assert {r[2] for r in brute(rows) if r[0] >= 30} == {30} and brute(rows)[1][2] == 10 and brute(rows)[3][2] == 21


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 60, 500, 6)))
    expect(spark, rows)


def test_near_copies_below_the_bound_are_not_paired(spark):
    """Copies that share most of their shingles, but too few, leave before a pair of them is made."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:134], rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2)])) for _ in range(200)]
    sets += [np.unique(np.concatenate([base[2:], sets[0][:1]])), base]
    rows = [(i, x.tobytes()) for i, x in enumerate(sets)]
    held = spark.createDataFrame(rows, "node long, shingles binary")
    labels = spark.createDataFrame([(i, i) for i in range(len(sets))], "node long, label long")
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if m.similar(sets[i], sets[j], 80)}
    met = {tuple(r) for r in m.crossing(m.prefixes(held, labels, 80), 80).collect()}
    assert linked and linked <= met
    assert len(met) < len(linked) + 400  # of 20,301 pairs


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for size in (1, 5, 300, 4000):
        a, b = (rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) for _ in range(2))
        b[: size // 2] = a[: size // 2]
        bits = sum((x ^ y).bit_count() for x, y in zip(*[np.array(m.parities(np.unique(v))).view("<u8").tolist() for v in (a, b)]))
        assert bits <= len(np.setxor1d(a, b)) and m.parities(a) == m.parities(np.sort(a))


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(df).count() == 0
    expect(spark, [(1, None), (2, ""), (None, None)])


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = sorted(map(tuple, m.op11_hyperminhash(spark, "/root/testdata/sf0.01").collect()))
    assert got == sorted(brute(docs))
