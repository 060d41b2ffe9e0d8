"""SimHash fingerprints, BK-trees and components against brute force."""

import random
import re

import pytest
import xxhash

from flowquarry.llm import simhash as m


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) if values else 0


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i])
    return [min((x for x in out[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", None, " \t\n\x0b\x0c\r", "One", "one  TWO", "a b c", "Ünïcode ÀB c d e\x1cf g", "x y z " * 50, "w%d " * 9000])
def test_fingerprint(text):
    assert m.fingerprint(text) == brute_fingerprint(text)


def near(rng, base, most):
    for b in rng.sample(range(64), rng.randrange(0, most)):
        base ^= 1 << b
    return base


def test_tree_finds_all_within():
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = list({near(rng, rng.choice(centres), 7) for _ in range(500)})
    tree = m.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:100] + [rng.getrandbits(64)]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


@pytest.mark.parametrize("crowd", [2048, 3])
def test_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(m, "CROWD", crowd)
    rng = random.Random(crowd)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = [near(rng, rng.choice(centres), 6) for _ in range(400)] + [0, 0, 0]
    ids = [rng.choice([i, i, i, None, 7]) for i in range(len(prints))]
    df = spark.createDataFrame([(i, m.signed(p)) for i, p in zip(ids, prints)], "doc_id long, fp long")
    want = sorted(zip([i is None for i in ids], [i or 0 for i in ids], prints, brute_components(ids, prints)), key=repr)
    got = [(r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in m.components(df).collect()]
    assert sorted(got, key=repr) == want


def test_frames(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text, "a"), (3, text.upper(), "b"), (3, text, "c"), (9, None, "d"), (8, "", "e"), (None, text + " end", "f"), (11, "quite different words here", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in m.near_duplicates(df).collect()}
    assert got[5, f"{m.fingerprint(text):016x}"] == 3 and got[9, "0" * 16] == 8 and got[8, "0" * 16] == 8
    kept = m.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 8, 11]
    assert m.near_duplicates(df.limit(0)).count() == 0 and m.representatives(df.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(300)) for w in ("apple", "pear", "plum", "fig"))
    rows = [(1, one, "a"), (1, two, "b"), (2, one, "c"), (3, two, "d"), (None, three, "e"), (None, three, "f"), (None, one, "g"), (None, four, "h"), (4, four, "i"), (4, four, "j")]
    kept = m.representatives(spark.createDataFrame(rows, "doc_id long, text string, name string"))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(1, one), (1, two), (None, three), (4, four)], key=repr) and kept.columns == ["doc_id", "text", "name"]


def test_extra_columns_with_any_name_stay(spark):
    text = " ".join(f"word{i}" for i in range(400))
    names = ["doc_id", "text", "_row_id", "_kept_id", "id", "digest", "kept_id", "kept_digest", "row", "fp", "a.b", "label"]
    rows = [(i, t, *[f"{i}{c}" for c in names[2:]]) for i, t in ((3, text), (5, text.upper()), (8, "quite different words here"))]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    kept = m.representatives(df)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, brute_components([r.doc_id for r in docs], prints))}
    assert {tuple(r) for r in m.op6_simhash(spark, "/root/testdata/sf0.001").collect()} == want


def test_crowded_keys_are_sliced(spark, monkeypatch):
    """Many fingerprints a few bits apart share all keys; slices find the same components."""
    rng = random.Random(9)
    values = {rng.getrandbits(64)}
    base = next(iter(values))
    while len(values) < 300:
        flips = rng.sample(range(16), rng.randrange(1, 6)) + [16 + b for b in rng.sample(range(48), rng.randrange(0, 4))]
        values.add(base ^ sum(1 << b for b in set(flips)))
    values = sorted(values)
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    want = {v: root(v) for v in values}
    nodes = spark.createDataFrame([(m.signed(v),) for v in values], "fp long").cache()
    keys = nodes.selectExpr("fp", "shiftrightunsigned(fp, 16) & 3 as key")
    parts, added = m.sliced(keys, 20)
    sizes = parts.groupBy("key", "part").count().toPandas()
    assert added > 0 and sizes["count"].max() < 100 and parts.count() > 300
    monkeypatch.setattr(m, "CROWD", 3)
    for slice_rows in (7, 64, 2048):
        edges = m.links(nodes, len(values), slice_rows=slice_rows)
        found = {r.fp: r.label for r in m.closed(edges).collect()}
        label = {v: found.get(m.signed(v), m.signed(v)) for v in values}
        assert all((label[a] == label[b]) == (want[a] == want[b]) for a in values for b in values)


def test_closure_draws_fewer_edges_each_round(spark, monkeypatch):
    """A group of many links is held once; later rounds only see what leads out of the nodes joined so far."""
    rng = random.Random(8)
    edges = [(a, b) for g in range(0, 120, 40) for a in range(g, g + 40) for b in range(g, a)]
    edges += [(200 + i, 201 + i) for i in range(100)] + [(400, i) for i in range(300, 340)] + [(500, 500)]
    names = list(range(501))
    rng.shuffle(names)
    edges = [(names[a] - 250, names[b] - 250) for a, b in edges]
    held = []
    settled = m.settled

    def seen(df):
        df = settled(df)
        if df.columns == ["a", "b"]:
            held.append(df.count())
        return df

    monkeypatch.setattr(m, "settled", seen)
    got = {r.fp: r.label for r in m.closed(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert held[0] == len(edges) and sum(held[1:]) < held[0] / 2
