"""The string kernel against its definition, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import toxicity as m

SF = "/root/testdata/sf0.1"


def brute_kernel(s, t, order, decay):
    def ends(word):
        out = {}
        for c in itertools.combinations(range(len(word)), order):
            out.setdefault(tuple(word[i] for i in c), []).append(decay ** (c[-1] - c[0] + 1))
        return out

    a, b = ends(s), ends(t)
    return sum(x * y for u in a if u in b for x in a[u] for y in b[u])


def test_kernel():
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8))) for _ in range(2)) for _ in range(60)]
    for order in (2, 3, 4):
        got = m.subsequence_kernel(m.coded([a for a, _ in pairs], 8), m.coded([b for _, b in pairs], 8), order, 0.7)
        assert got == pytest.approx([brute_kernel(a, b, order, 0.7) for a, b in pairs])


def test_words_and_windows():
    assert "idiot" in m.words_of("you i d i o t here") and m.letters("i.d-i*o7t") == "idiot"
    assert "".join(w[: m.STEP] for w in m.windows("x" * 11 + "y" * 80)).startswith("x" * 11)
    assert all(len(w) <= m.WINDOW for w in m.windows("q" * 1000))
    likeness = m.Landmarks(["idiot", "pathetic"]).likeness(["idiot", "idxiot", "thing", "patheti", "xxpatheticxx"])
    found = {(int(w), int(k)): v for w, k, v in zip(*likeness)}
    assert found[0, 0] == pytest.approx(1) and 0 < found[1, 0] < 1 and found[4, 1] == pytest.approx(1)
    assert found.get((2, 0), 0) == 0 and found.get((3, 1), 0) == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = m.op5_toxicity(spark, SF).join(labels, "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    caught = n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0))
    wrong = n.get((0, 1), 0) / (n.get((0, 1), 0) + n.get((0, 0), 0))
    # Some of the toxic rows of this table hold none of the words that tell the labels apart.
    assert caught >= 0.8 and wrong <= 0.02


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "some words", 4), (2, "", 5), (2, "", 5), (3, "z" * 100_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 0), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        got = m.toxicity(docs, rows)
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 5
        assert got.filter("score < 0 OR score > 1 OR score IS NULL OR held_out IS NULL").count() == 0
        assert m.without_toxic(docs, rows).columns == docs.columns
    assert m.toxicity(docs.limit(0), labels).count() == 0
    crc = docs.select("doc_id", m.held_out(F.col("doc_id")).alias("h")).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in crc)


def test_scores_do_not_depend_on_neighbours():
    landmarks = m.Landmarks(["idiot", "stupid"])
    texts = ["you idiot", "nothing here", "st-upid and idxiot", ""]
    together = m.Describer(landmarks)(texts)
    assert np.array_equal(together, np.vstack([m.Describer(landmarks)([t]) for t in texts]))


def test_words_after_signs_and_inside_long_runs():
    describe = m.Describer(m.Landmarks(["^moron", "^大白痴", "^twit", "^git"]))
    for text in ("well,moron", "you-moron", "x/moron", "#you_moron", "you,m.o.r.o.n", "you-mo-ron", "moron's", "q" * 60 + "moron" + "z" * 60):
        assert describe([text])[0, 0] == pytest.approx(1), text
    assert describe(["这个人真是大白痴吧"])[0, 1] == pytest.approx(1) and describe(["you/git"])[0, 3] == pytest.approx(1)
    # Every letter put in costs the decay, none the whole likeness.
    values = [describe(["mo" + "x" * n + "ron"])[0, 0] for n in range(7)]
    assert all(v >= m.DECAY**n for n, v in enumerate(values)) and values == sorted(values, reverse=True)
    assert describe(["digit outwits"]).max() <= m.DECAY**2  # words count where they begin, others as letters put in


def test_short_words_become_landmarks(spark):
    docs = [(i, f"{'you git' if i % 2 else 'my friend'} number{'abcdefghij'[i % 10]} word{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} again") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    landmarks, _ = m.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert "^git" in landmarks.words
