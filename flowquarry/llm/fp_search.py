"""Ranked lexical search: branch and bound over document FP-trees.

Items are asked in blocks of ``BLOCK_ITEMS``. A document is restricted to the terms of a block:
its vector holds their occurrences, ordered by falling document frequency. Documents whose
vectors begin alike share the path of a trie, a path that no document leaves has one node, and
nodes of at most ``LEAF`` documents are leaves. Every node keeps the greatest occurrence of
each term and the smallest m among its documents, so that no document below scores more than
the node's bound. For each item a tree is searched depth first, best bound first; nodes whose
bound is below the item's k-th best score are left out. A task builds one tree after the other
over a bounded number of its documents, keeps the k best of every item through all of them, and
reports only those; a window over (items x tasks x k) rows ranks them.

The score grows with a term's occurrences and falls with m, also after the rounding division,
so a bound is never too low and the result is exact, whatever the order of the documents.

Defined cases: a document that is null or holds no term counts for nothing; documents without
id or with repeated ids are ranked each, those without id last among equal scores; very long
texts are whole, one at a time; of rows that repeat an item's id the smallest text asks, items
without id or terms have no rows; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import arrow_schema, map_rows, settled, table

TOP = 10
#: Items whose terms a document is restricted to at once.
BLOCK_ITEMS = 256
#: Documents of a leaf.
LEAF = 64
#: Documents times terms of a tree, and its most documents.
TREE_CELLS = 12_000_000
TREE_DOCS = 8192
#: ASCII signs end terms, A-Z are lower-cased; all other characters belong to terms.
ENDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode().translate(ENDS).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one adds; grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


@dataclass
class Node:
    first: int
    last: int
    tf: np.ndarray
    m: int
    children: list[Node]
    #: Greatest occurrences and smallest m of all children, one row each.
    below_tf: np.ndarray | None = None
    below_m: np.ndarray | None = None


class FPTree:
    """Documents in trie order with the maxima of every subtree.

    ``counts`` has a row of occurrences for each document, its columns in the order of falling
    document frequency; ``m`` and ``ids`` belong to the rows.
    """

    def __init__(self, counts: np.ndarray, m: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        # Bits of presence, first column first, sort like the trie's paths.
        bits = np.packbits(counts > 0, axis=1)
        order = np.lexsort(bits.T[::-1])[::-1] if bits.shape[1] else np.arange(len(counts))
        self.counts, self.m, self.ids, self.leaf = counts[order], m[order], ids[order], leaf
        self.paths = [np.flatnonzero(row) for row in self.counts > 0]
        self.root = self.node(0, len(order), 0) if len(order) else None

    def node(self, first: int, last: int, depth: int) -> Node:
        children: list[Node] = []
        if last - first > self.leaf:
            parts = [(first, last)]
            while len(parts) == 1:  # a path that no document leaves has one node
                step = [p[depth] if len(p) > depth else -1 for p in self.paths[first:last]]
                cuts = [first, *(first + i for i in range(1, len(step)) if step[i] != step[i - 1]), last]
                parts = list(zip(cuts, cuts[1:]))
                depth += 1
                if len(parts) == 1 and step[0] == -1:  # documents with one and the same path
                    return Node(first, last, self.counts[first:last].max(0), int(self.m[first:last].min()), [])
            children = [self.node(a, b, depth) for a, b in self.joined(parts)]
        if not children:
            return Node(first, last, self.counts[first:last].max(0), int(self.m[first:last].min()), [])
        tf, low = np.stack([c.tf for c in children]), np.array([c.m for c in children])
        return Node(first, last, tf.max(0), int(low.min()), children, tf, low)

    def joined(self, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Neighbouring small branches become one leaf."""
        out: list[tuple[int, int]] = []
        for a, b in parts:
            if out and b - out[-1][0] <= self.leaf:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def search(self, columns: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Take this tree's documents into ``best``, a heap of the k best (score, -id)."""
        stack = [(0, self.root)] if self.root else []
        while stack:
            bound, node = stack.pop()
            if len(best) == k and bound and bound < best[0][0]:
                continue
            if node.children:
                bounds = (gain(node.below_tf[:, columns], node.below_m[:, None]) * weights).sum(1)
                least = best[0][0] if len(best) == k else 1
                # The best child is searched first; equal bounds may still hold a smaller id.
                stack += [(int(bounds[c]), node.children[c]) for c in np.argsort(bounds, kind="stable").tolist() if bounds[c] >= least]
                continue
            at = slice(node.first, node.last)
            scores = (gain(self.counts[at][:, columns], self.m[at, None]) * weights).sum(1)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[i]), -int(self.ids[node.first + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


#: Ids inside a task: a missing one is greater than every other.
NO_ID = 1 << 63


def restricted(df: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, vector): the number of terms, and (term, occurrences) pairs of the vocabulary."""

    def make():
        place = {t: i for i, t in enumerate(vocabulary)}

        def rows(ids, texts):
            out = []
            for i, text in zip(ids, texts):
                found = terms(text)
                if found:
                    held = [(place[t], c) for t, c in Counter(found).items() if t in place]
                    out.append((i, len(found), np.array(held, "<i4").tobytes()))
            return out

        return rows

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(source, make, "doc_id long, n long, vector binary")


def held_by(vectors: DataFrame, size: int) -> list[int]:
    """How many documents hold each term of the vocabulary; tasks add up their own first."""
    out = arrow_schema("term int, df long")

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                pairs = np.frombuffer(b"".join(batch["vector"].slice(start, 4096).to_pylist()), "<i4").reshape(-1, 2)
                total += np.bincount(pairs[:, 0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], schema=out)

    found = [0] * size
    for r in vectors.select("vector").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[r.term] = r.df
    return found


def best_of_tasks(vectors: DataFrame, items: list[list[int]], order: list[int], weights: list[int], docs: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item."""
    out = arrow_schema("item int, doc_id long, score long")
    size = len(order)
    tree_docs = max(LEAF, min(TREE_DOCS, TREE_CELLS // max(1, size)))

    def run(batches):
        column = np.empty(size, np.int64)
        column[order] = np.arange(size)
        by_column = np.array(weights, np.int64)[order]
        asked = [np.sort(column[np.array(i, np.int64)]) for i in items]
        best: list[list] = [[] for _ in items]

        def take(ids, counts, vectors):
            pairs = np.frombuffer(b"".join(vectors), "<i4").reshape(-1, 2)
            row = np.repeat(np.arange(len(ids)), [len(v) // 8 for v in vectors])
            table = np.zeros((len(ids), size), np.int32)
            table[row, column[pairs[:, 0]]] = pairs[:, 1]
            m = 10 + (90 * np.array(counts, np.int64) * docs) // length
            tree = FPTree(table, m, np.array([NO_ID if i is None else i for i in ids], object))
            for columns, heap in zip(asked, best):
                tree.search(columns, by_column[columns], heap, k)

        waiting: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for held, name in zip(waiting, ("doc_id", "n", "vector")):
                    held += part[name].to_pylist()
                while len(waiting[0]) >= tree_docs:
                    take(*(held[:tree_docs] for held in waiting))
                    for held in waiting:
                        del held[:tree_docs]
        if waiting[0]:
            take(*waiting)
        found = [(i, None if -e[1] == NO_ID else -e[1], e[0]) for i, heap in enumerate(best) for e in heap]
        columns = list(zip(*found)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of all."""
    spark = docs.sparkSession
    asking = items.filter(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("long").alias("item_id"))
    asking = settled(asking.agg(F.min(item_text).alias("text")))
    blocks = max(1, -(-asking.count() // BLOCK_ITEMS))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        asked = {r.item_id: set(terms(r.text)) for r in asking.filter(F.col("block") == block).collect()}
        vocabulary = sorted(set().union(*asked.values()))
        if not vocabulary:
            continue
        vectors = settled(restricted(docs, id_col, text_col, vocabulary))
        n, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        df = held_by(vectors, len(vocabulary))
        place = {t: i for i, t in enumerate(vocabulary)}
        ids = sorted(i for i, held in asked.items() if held)
        order = sorted(range(len(vocabulary)), key=lambda t: -df[t])
        weights = [weight(n, d) for d in df]
        found = best_of_tasks(vectors, [[place[t] for t in asked[i]] for i in ids], order, weights, n, length, k)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        parts.append(found.join(names, "item").select("item_id", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS pos, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT doc_id, pos, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM c),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
f AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(t) AS term FROM c) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
m AS (SELECT c.doc_id, c.pos, 10 + (90 * c.n * s.docs) // s.length AS m FROM c, s),
r AS (SELECT i.item_id, m.doc_id, m.pos, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (pos) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def op13_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERY = op13_fp_search
