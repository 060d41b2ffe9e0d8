"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every row. For each query a global histogram of scores over
its current range tells in which bin the k-th best score lies; the range shrinks to that bin
and the histogram is counted anew, until the bin is one value wide. That value is the cut: a
last pass emits the scores above it and, of the ties at it, the smallest ids.

Rows are dealt into slots and queries into blocks, so that a task holds a bounded number of
both. A task reports only the bins from its best score down to the one in which its own count
reaches k: the global k-th score is never below that. Ties leave a task as at most k ids.

Defined cases: vectors that are null or hold null or non-finite components, and rows without
id, take no part; vectors meet those of their own length; of rows that repeat a query's id the
smallest vector asks once, and none of them is its candidate; other repeated rows are
candidates each; extra columns are ignored; no queries give no rows. Scores are exact up to
62 bits, so that their differences fit a long; beyond that, or where a component itself does
not fit a long, the job fails and says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import arrow_schema, settled, table

#: Rows of a slot, queries of a block: the most that meet in one task.
SLOT_ROWS = 8192
BLOCK_QUERIES = 1024
#: Rows scored at once inside a task.
CHUNK = 2048
BINS = 256
MOST_SCORE = 1 << 62


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    def entry(x: Column) -> Column:
        value = x.cast("double") * scale
        message = F.concat(F.lit("component does not fit a long: "), value.cast("string"))
        return F.when(F.abs(value) >= float(1 << 63), F.raise_error(message).cast("long")).otherwise(F.floor(value).cast("long"))

    vector = F.transform(F.col(vector_col), entry)
    return df.filter(F.col(id_col).isNotNull() & sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))


def matrix(column: pa.ChunkedArray, rows: int, kind) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows else np.zeros(0)
    return flat.astype(kind, copy=False).reshape(rows, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where those are exact, through Python's integers
    where longs might not hold them."""
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] if q.size and x.size else 0.0
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < MOST_SCORE:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    if max(abs(exact.max()), abs(exact.min())) >= MOST_SCORE:
        raise OverflowError("inner product beyond 62 bits")
    return exact.astype(np.int64)


def scored(left: pa.Table, right: pa.Table):
    """Chunks of (queries' columns, row ids, scores, mask of candidates)."""
    q, qid = matrix(left["v"], left.num_rows, np.int64), left["id"].to_numpy()
    x, xid = matrix(right["v"], right.num_rows, np.int64), right["id"].to_numpy()
    order = np.argsort(xid, kind="stable")  # ties come with the smallest ids first
    for start in range(0, len(order), CHUNK):
        part = order[start : start + CHUNK]
        ids = xid[part]
        yield ids, products(q, x[part]), qid[:, None] != ids[None, :]


def extent_pass(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Per query: least and greatest score and number of candidates."""
    n = left.num_rows
    low, high, count = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
    for _, score, mask in scored(left, right):
        low = np.minimum(low, np.where(mask, score, np.iinfo(np.int64).max).min(1))
        high = np.maximum(high, np.where(mask, score, np.iinfo(np.int64).min).max(1))
        count += mask.sum(1)
    seen = count > 0
    return pa.table({"id": left["id"].to_numpy()[seen], "low": low[seen], "high": high[seen], "n": count[seen]})


def histogram_pass(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Per query: counts of the bins of its range that can hold its k-th score."""
    n = left.num_rows
    low, high, need = (left[c].to_numpy()[:, None] for c in ("low", "high", "need"))
    width = (high - low) // BINS + 1
    counts = np.zeros((n, BINS), np.int64)
    rows = np.arange(n)[:, None] * BINS
    for _, score, mask in scored(left, right):
        mask &= (score >= low) & (score <= high)
        bins = (rows + (score - low) // width)[mask]
        counts += np.bincount(bins, minlength=n * BINS).reshape(n, BINS)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    at = np.nonzero((counts > 0) & (above < need))
    return pa.table({"id": left["id"].to_numpy()[at[0]], "bin": at[1].astype(np.int64), "n": counts[at]})


def select_pass(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Scores above each query's cut, and the smallest ids at it."""
    out = [(np.zeros(0, np.int64),) * 3]
    qid, cut, need = (left[c].to_numpy() for c in ("id", "low", "need"))
    room = need.copy()
    for ids, score, mask in scored(left, right):
        tie = mask & (score == cut[:, None])
        rank = np.cumsum(tie, axis=1)
        take = np.nonzero((mask & (score > cut[:, None])) | (tie & (rank <= room[:, None])))
        out.append((qid[take[0]], ids[take[1]], score[take]))
        room -= np.minimum(room, rank[:, -1])
    query, ids, score = (np.concatenate(c) for c in zip(*out))
    return pa.table({"query_id": query, "vec_id": ids, "score": score})


def meet(queries: DataFrame, rows: DataFrame, step, schema: str) -> DataFrame:
    """Run a pass on every block of queries with every slot of rows of the same length."""
    key = ["dim", "slot", "block"]
    out = arrow_schema(schema)
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(
        lambda k, left, right: step(k, left, right).cast(out) if left.num_rows and right.num_rows else out.empty_table(), schema
    )


def top_k(df: DataFrame, queries: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query."""
    rows = quantised(df, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    asked = quantised(df.filter(queries), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n, m = rows.count(), asked.count()
    slots, blocks = max(1, -(-n // SLOT_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    # A row goes to its slot once per block of queries, a query to its block once per slot.
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", "v"), F.lit(slots)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))

    state = meet(asked.withColumn("slot", everywhere), rows, extent_pass, "id long, low long, high long, n long")
    state = state.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.least(F.sum("n"), F.lit(k)).alias("need"))
    state = settled(state)
    while (state.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0) > 0:
        searched = asked.join(state, "id").withColumn("slot", everywhere)
        counts = meet(searched, rows, histogram_pass, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.col("bin").desc())  # at most BINS rows a query
        counts = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).join(state, "id")
        width = F.floor((F.col("high") - F.col("low")) / BINS).cast("long") + 1
        low = F.col("low") + F.col("bin") * width
        state = settled(
            counts.filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).select(
                "id", low.alias("low"), F.least(low + width - 1, F.col("high")).alias("high"), (F.col("need") - F.col("above")).alias("need")
            )
        )
    found = meet(asked.join(state, "id").withColumn("slot", everywhere), rows, select_pass, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERY = op10_histogram_topk
