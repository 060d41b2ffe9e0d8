"""Exact substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from flowquarry.llm import suffix_dedup as m


def brute(rows):
    last = float("inf")
    rank = lambda i: last if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - m.LENGTH + 1):
            s = b[k : k + m.LENGTH]
            first[s] = min(first.get(s, last), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - m.LENGTH + 1):
            if first[b[k : k + m.LENGTH]] < rank(i):
                gone[k : k + m.LENGTH] = b"\1" * m.LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixture(seed, n=60, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 2 * words)))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a : a + rng.randrange(20, 200)] + rng.choice(["", " ", "x"])
        rows.append((rng.choice([i, i, i, rng.randrange(n)]), text))
    rows += [(n + k, rng.choice(rows)[1]) for k in range(15)]
    rows += [(3, None), (n + 50, ""), (n + 51, "a" * 400), (n + 52, "a" * 300 + "b"), (None, "a" * 120), (None, rows[0][1] + rows[1][1]), (n + 53, "short"), (5, rows[5][1]), (5, rows[5][1])]
    return rows


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for _ in range(60):
        parts = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 8))]
        parts += parts[:1]
        order, symbols, end = m.suffix_array(parts)
        starts = np.r_[0, np.cumsum([len(p) + 1 for p in parts])[:-1]]
        number = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        text = lambda p: tuple(symbols[p : end[p]])  # noqa: E731, B023
        want = sorted(range(len(symbols)), key=lambda p: (*[int(c) for c in text(p)], 0, int(number[p])))
        assert [(text(p), number[p]) for p in order] == [(text(p), number[p]) for p in want]
        lcp = m.common_prefixes(order, symbols, end, starts)
        for n in range(1, len(order)):
            a, b = text(order[n - 1]), text(order[n])
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert lcp[n] == k


def test_anchors_are_those_of_their_strings(monkeypatch):
    monkeypatch.setattr(m, "PIECE", 64)
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(0, 300))) for _ in range(20)]
    found = m.Anchored(texts)
    seen = {}
    covered = []
    for i in range(len(found.low)):
        for p in range(found.low[i], found.stop[i] - m.LENGTH + 1):
            s = found.data[p : p + m.LENGTH].tobytes()
            covered.append(p)
            assert seen.setdefault(s, found.key[i]) == found.key[i]
    want = [int(s) + k for s, t in zip(found.starts, texts) for k in range(len(t) - m.LENGTH + 1)]
    assert covered == want


@pytest.mark.parametrize(("seed", "shard", "array", "hot"), [(1, 12 << 20, 2 << 20, 20_000), (2, 1500, 300, 20_000), (3, 4000, 700, 3), (4, 900, 200, 1)])
def test_same_as_brute_force(spark, monkeypatch, seed, shard, array, hot):
    for name, value in (("SHARD_BYTES", shard), ("ARRAY_BYTES", array), ("MERGED_KEYS", 60)):
        monkeypatch.setattr(m, name, value)
    rows = mixture(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, key string")
    got = sorted(map(tuple, m.substring_dedup(df, hot=hot).collect()), key=repr)
    assert got == brute(rows)


def test_borders_inside_a_key(monkeypatch):
    monkeypatch.setattr(m, "ARRAY_BYTES", 150)
    rng = random.Random(9)
    core = bytes(rng.choice(b"abcd") for _ in range(60))
    parts = sorted({core[k:] + bytes(rng.choice(b"xy") for _ in range(12 + k)) for k in range(4) for _ in range(6)})
    docs = np.arange(len(parts))[::-1].copy()
    least, owner = m.resolve(np.zeros(len(parts), np.uint64), parts, docs)
    first = {}
    for p, d in zip(parts, docs):
        for k in range(len(p) - m.LENGTH + 1):
            s = p[k : k + m.LENGTH]
            first[s] = min(first.get(s, 10**9), int(d))
    want = [first[p[k : k + m.LENGTH]] for p in parts for k in range(len(p) - m.LENGTH + 1)]
    assert least.tolist() == want and len(owner) == len(want)


def test_spans_and_empty_table(spark):
    text = "".join(chr(97 + (7 * i * i + i) % 26) for i in range(120))
    df = spark.createDataFrame([(1, text), (2, "new " + text + " end")], "doc_id long, text string")
    rows = {r.doc_id: r for r in m.substring_dedup(df, digests=False).collect()}
    assert bytes(rows[1].kept).decode() == text and rows[1].spans == []
    assert bytes(rows[2].kept) == b"new  end" and [tuple(s) for s in rows[2].spans] == [(4, 124)]
    assert m.substring_dedup(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, m.substring_dedup(docs).collect()), key=repr) == brute(rows)
