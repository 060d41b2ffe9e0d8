"""Approximate nearest neighbours: probed lists scanned by an adaptive number of dimensions.

Inner products become distances in one more dimension: with M the greatest norm, x gets the
component sqrt(M^2 - |x|^2) and a query 0, so that nearness is the distance of the extended
vectors. Those are rotated at random once, which makes a partial sum of squared differences,
scaled up, an estimate of the whole. Inside a probed list the columns are read block by block,
and a candidate is given up as soon as the estimate exceeds the query's current k-th distance
by more than the test allows: d_t * D / t > (r * (1 + EPSILON / sqrt(t)))^2. What survives all
blocks is scored exactly, in double precision, on the original vectors.

The lists come from k-means on a sample of bounded size (about ``SAMPLE`` rows by hash); every row
is assigned. Lists are searched in groups, a group in slots of bounded size with blocks of
queries of bounded size, so a list with a third of all rows is spread over many tasks.

Defined cases: vectors that are null, zero or hold null or non-finite components, rows
without id, and vectors of another length than most have, take no part; of rows that repeat a
query's id the smallest vector asks once, and none of them is its candidate; extra columns are
ignored; no queries or no candidates give no rows. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import arrow_schema, settled, table
from flowquarry.llm.histogram_topk import matrix, sound

SAMPLE = 32_768
MOST_LISTS = 2048
ROUNDS = 12
#: Part of the lists a query probes, and the least number of them.
PROBED = 0.6
LEAST_PROBED = 12
#: Columns of a block, and the width of the test.
COLUMNS = 16
EPSILON = 2.1
#: Share of the pairs up to which a block is summed pair by pair.
DENSE = 0.1
SLOT_ROWS = 8192
BLOCK_QUERIES = 1024
CHUNK = 1024


def centroids_of(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """k-means of a bounded sample, from rows spaced evenly in its order."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].astype(np.float64)
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        home = nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        counts = np.bincount(home, minlength=lists)
        empty = counts == 0
        centres = sums / np.maximum(counts, 1)[:, None]
        if empty.any():
            centres[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each point, nearest first, ties to the smaller number."""
    out = []
    norms = (centres**2).sum(1)
    for start in range(0, len(points), CHUNK):
        d = norms[None, :] - 2 * points[start : start + CHUNK] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), int)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def extended(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most * most - (x**2).sum(1), 0.0))
    return np.hstack([x, rest[:, None]])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components."""
    total = np.zeros(len(q))
    for c in range(q.shape[1]):
        total += q[:, c] * x[:, c]
    return total


def better(best: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Take values, in order of their rows, into the ascending k least of each row."""
    own, counts = np.unique(rows, return_counts=True)
    k = best.shape[1]
    wide = np.full((len(own), k + int(counts.max())), np.inf)
    wide[:, :k] = best[own]
    first = np.cumsum(counts) - counts
    wide[np.repeat(np.arange(len(own)), counts), k + np.arange(len(rows)) - np.repeat(first, counts)] = values
    best[own] = np.sort(np.partition(wide, k - 1, axis=1)[:, :k], axis=1)


def scan_lists(q: np.ndarray, qid: np.ndarray, probed: list[np.ndarray], x: np.ndarray, xid: np.ndarray, lists: np.ndarray, k: int, most: float, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best of some lists for the queries that probe them, by early abandoning.

    A query's k-th distance is carried from list to list. While many pairs are still in, a
    block of columns is one product for all of them; then only the pairs left are summed on.
    """
    rq = np.hstack([q, np.zeros((len(q), 1))]) @ turn
    order = np.lexsort((xid, lists))
    x, xid, lists = x[order], xid[order], lists[order]
    rx = extended(x, most) @ turn
    dim = rq.shape[1]
    slack = 1e-9 * (most * most + (q**2).sum(1)) + 1e-300
    asks = np.repeat(np.arange(len(q)), [len(p) for p in probed])
    asked = np.concatenate(probed) if len(probed) else np.zeros(0, int)
    by_list = np.argsort(asked, kind="stable")
    asks, asked = asks[by_list], asked[by_list]
    best = np.full((len(q), k), np.inf)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    borders = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1], True]) if len(lists) else np.zeros(0, int)
    cuts = [c for a, b in zip(borders, borders[1:]) for c in range(a, b, CHUNK)] + [len(lists)]
    for start, stop in zip(cuts, cuts[1:]):
        mine = asks[slice(*np.searchsorted(asked, [lists[start], lists[start] + 1]))]
        if not len(mine):
            continue
        near, part = rq[mine], rx[start:stop]
        radius, room = best[mine, k - 1], slack[mine]
        alive = qid[mine][:, None] != xid[None, start:stop]
        total = np.zeros(alive.shape)
        rows = cols = partial = None
        for c in range(0, dim, COLUMNS):
            block = slice(c, min(c + COLUMNS, dim))
            t = block.stop
            limit = (radius if t == dim else radius * ((1 + EPSILON / np.sqrt(t)) ** 2 * t / dim)) + room
            if rows is None:
                a, b = near[:, block], part[:, block]
                total += (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)
                alive &= total <= limit[:, None]
                if t == dim or np.count_nonzero(alive) < DENSE * alive.size:
                    rows, cols = np.nonzero(alive)
                    partial = total[rows, cols]
            else:
                partial = partial + ((near[rows, block] - part[cols, block]) ** 2).sum(1)
                stay = partial <= limit[rows]
                rows, cols, partial = rows[stay], cols[stay], partial[stay]
        if len(rows):
            better(best, mine[rows], np.maximum(partial, 0))
            found.append((mine[rows], cols + start, partial))
    rows, cols, partial = (np.concatenate(c) for c in zip(*found))
    stay = partial <= best[rows, k - 1] + slack[rows]
    rows, cols = rows[stay], cols[stay]
    score = exact(q[rows], x[cols])
    order = np.lexsort((xid[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return qid[rows[keep]], xid[cols[keep]], score[keep]


def neighbours(df: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products found for each query."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.filter(F.col(id_col).isNotNull() & sound(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"), queries.alias("asks")
    )
    rows = rows.withColumn("norm", norm).filter("norm > 0").withColumn("dim", F.size("v"))
    shapes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most"))
    top = shapes.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return spark.createDataFrame([], result)
    dim, n, most = top.dim, top.n, top.most
    rows = rows.filter(F.col("dim") == dim).select("id", "v", "asks")

    # Hashes are even: a share of their range is a share of the rows, without sorting them.
    cut = min(2.0**63 - 1024, -(2.0**63) + 2.0**64 * SAMPLE / n)
    sample = rows.select(F.xxhash64("id", "v").alias("h"), "v").filter(F.col("h") <= int(cut) if n > SAMPLE else F.lit(True)).toArrow()
    sample = sample.sort_by("h")
    points = extended(matrix(sample["v"], sample.num_rows, np.float64), most)
    lists = int(max(1, min(MOST_LISTS, len(points) // 8, round(2 * n**0.5))))
    centres = centroids_of(points, lists)
    probes = int(min(lists, max(LEAST_PROBED, -(-lists * PROBED // 1))))
    turn = rotation(dim + 1)
    groups = int(min(lists, -(-n // SLOT_ROWS)))  # lists searched together, by number

    def assign(batches):
        for batch in batches:
            v = matrix(pa.chunked_array([batch["v"]]), batch.num_rows, np.float64)
            home = nearest(extended(v, most), centres, 1)[:, 0]
            columns = [batch["id"], batch["v"], pa.array(home, pa.int32()), pa.array(home % groups, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "list", "group"])

    def probe(batches):
        for batch in batches:
            v = matrix(pa.chunked_array([batch["v"]]), batch.num_rows, np.float64)
            near = np.sort(nearest(np.hstack([v, np.zeros((len(v), 1))]), centres, probes), axis=1)
            for g in range(groups):
                mine = [row[row % groups == g] for row in near]
                at = np.flatnonzero([len(m) > 0 for m in mine])
                columns = [batch["id"].take(pa.array(at)), batch["v"].take(pa.array(at)), pa.array([mine[i] for i in at], pa.list_(pa.int32())), pa.array(np.full(len(at), g), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "lists", "group"])

    homes = rows.select("id", "v").mapInArrow(assign, "id long, v array<double>, list int, group int")
    asked = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    visits = asked.mapInArrow(probe, "id long, v array<double>, lists array<int>, group int")
    # One row per group, at most MOST_LISTS: how many slots and blocks it takes.
    sizes = homes.groupBy("group").agg(F.count("*").alias("rows")).join(visits.groupBy("group").agg(F.count("*").alias("calls")), "group")
    sizes = settled(sizes.select("group", F.ceil(F.col("rows") / SLOT_ROWS).cast("int").alias("slots"), F.ceil(F.col("calls") / BLOCK_QUERIES).cast("int").alias("blocks")))
    sizes = F.broadcast(sizes)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = homes.join(sizes, "group").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")).withColumn("block", each("blocks"))
    visits = visits.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("slot", each("slots"))
    schema = "query_id long, vec_id long, score double"
    out = arrow_schema(schema)

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        x, q = (matrix(t["v"], t.num_rows, np.float64) for t in (right, left))
        probed = [np.asarray(p, int) for p in left["lists"].to_pylist()]
        found = scan_lists(q, left["id"].to_numpy(), probed, x, right["id"].to_numpy(), right["list"].to_numpy(), k, most, turn)
        return pa.table(dict(zip(out.names, found)), schema=out)

    key = ["group", "slot", "block"]
    found = visits.select("id", "v", "lists", *key).groupBy(*key).cogroup(dealt.select("id", "v", "list", *key).groupBy(*key)).applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERY = op8_dimension_scan
