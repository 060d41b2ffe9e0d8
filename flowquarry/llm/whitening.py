"""Embedding whitening with MLlib's BlockMatrix: scatter, eigenvectors, projection.

Entries become long integers, so the count n and the sums S of the distinct vectors (the fit
list) are exact. The distinct vectors are indexed, centred and packed into blocks of about
``CELLS`` numbers. The transposed block matrix times the block matrix is the scatter; its
eigenvectors are found on the driver, whose matrix has only dimensions squared entries. The
block matrix times the whitening matrix projects every distinct vector, and each row of the
table finds its projection by its vector.

A plain X'X has a single result block, which one task would compute from the whole table. The
left factor therefore holds block i in column stripe i mod g and the right one in stripe
i div g mod g: their product has g * g blocks, each the scatter of a bounded number of blocks,
and the scatter is their sum. BlockMatrix plans a product from the places of its blocks, which
it gathers on the driver; a product hence covers at most ``SLAB`` blocks, larger tables take
several.

Defined cases: rows whose vector is null or holds null or non-finite entries take no part;
other rows stay, also without id or repeated, and repeated vectors count once in the fit;
vectors of each length are whitened on their own, empty ones not at all; of fewer dimensions
than components there are as many components as dimensions; a component without variance (one
distinct vector, dependent dimensions) has null for whitened and is left out of the identity
error, and explained is null if nothing varies; extra columns are ignored; an empty table gives
no rows. Deviations beyond a long raise Spark's overflow error rather than wrap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import settled, table

SCALE = 256
COMPONENTS = 4
#: Numbers in a block, about.
CELLS = 1 << 19
#: Blocks that meet in a task of the scatter, about.
BLOCKS_OF_A_TASK = 4
#: Blocks of one product.
SLAB = 65_536
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (c != inf) & (c != -inf))


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x) of the rows that take part, x in long integers."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.filter(sound(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def indexed(fit: DataFrame, n: int, rows: int) -> DataFrame:
    """(block, index, x): distinct vectors dealt evenly into blocks, in order inside each."""
    blocks = -(-n // rows)
    dealt = fit.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("x"))
    return settled(dealt.select("block", "x", place.alias("place")))


def packed(placed: DataFrame, sums: list[int], n: int, rows: int) -> DataFrame:
    """(block, cells): each block's centred vectors, column by column, filled up with zeros."""
    total = np.array(sums, np.float64)

    def pack(t: pa.Table) -> pa.Table:
        flat = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        centred = np.zeros((rows, flat.shape[1]))
        centred[t["place"].to_numpy() - 1] = flat - total / n
        return pa.table({"block": t["block"][:1], "cells": pa.array([centred.tobytes(order="F")], pa.binary())})

    return placed.groupBy("block").applyInArrow(pack, "block int, cells binary")


def stripes(blocks: DataFrame, first: int, rows: int, width: int, stripe) -> BlockMatrix:
    """The block matrix whose block i stands in column stripe ``stripe(i)``."""

    def block(row):
        i = row.block - first
        return (i, stripe(i)), DenseMatrix(rows, width, np.frombuffer(row.cells))

    return BlockMatrix(blocks.rdd.map(block), rows, width)


def scatter_of(blocks: DataFrame, first: int, count: int, rows: int, width: int) -> np.ndarray:
    """The sum of every block's transpose times itself."""
    g = max(1, int(np.ceil(np.sqrt(count / BLOCKS_OF_A_TASK))))
    blocks = blocks.repartition(g * g, "block")
    left = stripes(blocks, first, rows, width, lambda i: i % g)
    right = stripes(blocks, first, rows, width, lambda i: i // g % g)
    product = left.transpose().multiply(right)
    return product.blocks.map(lambda block: block[1].toArray()).treeReduce(lambda a, b: a + b)


def projected(spark: SparkSession, blocks: DataFrame, first: int, rows: int, width: int, matrix: np.ndarray) -> DataFrame:
    """(block, place, w): every indexed vector times the whitening matrix."""
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(*matrix.shape, matrix.ravel(order="F")))], 1), width, matrix.shape[1])
    product = stripes(blocks, first, rows, width, lambda i: 0).multiply(right)
    found = product.toIndexedRowMatrix().rows.map(lambda r: (first + r.index // rows, r.index % rows + 1, r.vector.toArray().tolist()))
    return spark.createDataFrame(found, "block int, place int, w array<double>")


def whitening_matrix(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, list[float | None]]:
    """Unit eigenvectors over the root of their eigenvalue as columns, and each one's share of the trace."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    order = np.argsort(-values, kind="stable")[: min(components, len(values))]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(scatter)) / n
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    varies = values > max(trace, 0) * len(scatter) * np.finfo(float).eps
    scaled = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1)), np.nan)
    return scaled, [None if trace <= 0 else float(v) / trace if ok else 0.0 for v, ok in zip(values, varies)]


def identity_error(white: DataFrame, good: list[int]) -> float:
    """The largest entry of the projections' covariance minus the identity."""
    pairs = [(i, j) for i in good for j in good if i <= j]
    if not pairs:
        return 0.0
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def whitened_alike(points: DataFrame, width: int, components: int) -> DataFrame:
    """The result for (vec_id, x) whose vectors all have ``width`` entries."""
    spark = points.sparkSession
    fit = settled(points.groupBy("x").agg(F.count("*").alias("copies")))
    n = fit.count()
    by_dimension = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"))
    sums = [r.s for r in by_dimension.orderBy("i").collect()]
    block_rows = max(1, CELLS // width)
    placed = indexed(fit, n, block_rows)
    rows = placed.agg(F.max("place")).first()[0]
    blocks = settled(packed(placed, sums, n, rows))
    slabs = [(a, min(SLAB, -(-n // block_rows) - a)) for a in range(0, -(-n // block_rows), SLAB)]
    parts = [(blocks.filter(F.col("block").between(a, a + size - 1)), a, size) for a, size in slabs]

    scatter = sum(scatter_of(part, a, size, rows, width) for part, a, size in parts)
    matrix, explained = whitening_matrix(scatter, n, components)
    white = None
    for part, a, _ in parts:
        one = projected(spark, part, a, rows, width, np.nan_to_num(matrix))
        white = one if white is None else white.union(one)
    # Zero rows that fill up a block are no vectors; the join with the places leaves them out.
    white = settled(placed.join(white, ["block", "place"]))
    good = [c for c in range(matrix.shape[1]) if not np.isnan(matrix[0, c])]
    error = identity_error(white, good)

    off = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: (F.lit(n).cast("long") * x - s) * (F.lit(n).cast("long") * x - s))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, d: a + d)
    each = F.explode(F.array(*[
        F.struct(
            F.lit(c + 1).alias("component"),
            (F.col("w")[c] if c in good else F.lit(None).cast("double")).alias("whitened"),
            F.lit(explained[c]).cast("double").alias("explained"),
        ) for c in range(matrix.shape[1])
    ])).alias("c")
    answer = white.select("x", deviation.alias("deviation"), "w")
    found = points.join(answer, "x").select("vec_id", "deviation", each)
    return found.select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error")
    )


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound vector."""
    points = settled(quantised(df, id_col, vector_col, scale))
    widths = sorted(r[0] for r in points.select(F.size("x")).distinct().collect())
    found = df.sparkSession.createDataFrame([], SCHEMA)
    for i, width in enumerate(widths):
        one = whitened_alike(points.filter(F.size("x") == width), width, components)
        found = one if i == 0 else found.union(one)
    return found


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERY = op12_whitening
