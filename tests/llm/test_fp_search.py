"""Branch and bound over FP-trees against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowquarry.llm import fp_search as m

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(found_terms(t))) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, length = len(held), sum(t.total() for _, t in held)
    holding = Counter(term for _, t in held for term in t)
    asked = {}
    for i, t in items:
        if i is not None:
            asked[i] = min((x for x in (asked.get(i), t) if x is not None), default=None)
    out = []
    for item, text in asked.items():
        scored = []
        for doc, words in held:
            low = 100 - 90 + (90 * words.total() * n) // length
            score = 0
            for term in set(found_terms(text)):
                tf = words[term]
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * holding[term] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * low))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        scored.sort()
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("text", [None, "", " -- ", "One two-THREE's x_y 3.14", "Ñandú ÀB\x7fc\x00d é", "日本語 text、mixed", "a " * 5000])
def test_terms(text):
    assert [t.decode() for t in m.terms(text)] == found_terms(text)


def documents(rng, count, words=60):
    vocabulary = [f"w{i}" for i in range(words)]
    for i in range(count):
        own = rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(words)], k=rng.choice([1, 3, 8, 30, 200]))
        yield i, " ".join(own)


def test_tree_bounds_and_order():
    rng = np.random.default_rng(1)
    counts = (rng.random((300, 13)) < np.linspace(0.9, 0.05, 13)).astype(np.int32) * rng.integers(1, 5, (300, 13)).astype(np.int32)
    low = rng.integers(10, 200, 300)
    tree = m.FPTree(counts, low, np.arange(300).astype(object), leaf=4)
    paths = [tuple(p.tolist()) for p in tree.paths]
    assert paths == sorted(paths, key=lambda p: [*p, 99])  # paths that begin alike stand together
    seen, nodes = [], [tree.root]
    while nodes:
        node = nodes.pop()
        rows = slice(node.first, node.last)
        assert (node.tf == tree.counts[rows].max(0)).all() and node.m == tree.m[rows].min()
        assert not node.children or [c.first for c in node.children] + [node.last] == [node.first] + [c.last for c in node.children]
        if not node.children:
            seen += range(node.first, node.last)
            assert node.last - node.first <= 4 or len(set(paths[rows])) == 1
        nodes += node.children
    assert sorted(seen) == list(range(300))
    weights = rng.integers(0, 900, 13)
    for k in (1, 5):
        for columns in (np.arange(13), np.array([12]), np.array([0, 7])):
            best = []
            tree.search(columns, weights[columns], best, k)
            scores = (m.gain(counts[:, columns], low[:, None]) * weights[columns]).sum(1)
            want = sorted(((-int(s), i) for i, s in enumerate(scores) if s > 0))[:k]
            assert sorted((-s, -i) for s, i in best) == want


def expect(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, score int")
    i = spark.createDataFrame([(j, t, 7) for j, t in items], "item_id long, text string, rank int")
    assert sorted(map(tuple, m.ranked(d, i, k).collect()), key=repr) == brute(docs, items, k)


@pytest.mark.parametrize(("block", "leaf", "cells"), [(256, 64, 12_000_000), (4, 3, 2_000)])
def test_ranking(spark, monkeypatch, block, leaf, cells):
    for name, value in (("BLOCK_ITEMS", block), ("LEAF", leaf), ("TREE_CELLS", cells)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(block)
    docs = list(documents(rng, 250))
    docs += [(1000 + i, docs[4][1]) for i in range(40)] + [(None, docs[5][1]), (None, "w1"), (3, docs[6][1]), (2000, None), (2001, " .,")]
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(70)], k=rng.choice([1, 4, 20])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "w1"), (3, "w2 w3"), (23, docs[4][1])]
    expect(spark, docs, items)


def test_few_documents(spark):
    expect(spark, [(1, "a b"), (2, "a a"), (9, "c")], [(5, "A b"), (6, "b c")], 2)
    for docs, items in (([], [(5, "a")]), ([(1, None)], [(5, "a")]), ([(1, "a")], [])):
        expect(spark, docs, items)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (list(map(tuple, spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect())) for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, m.op13_fp_search(spark, sf).collect()), key=repr) == brute(docs, items)
