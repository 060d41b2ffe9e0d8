"""Row positions and top-n within groups that stay balanced when one group is huge."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.session import fresh_path

#: Rows a range of an order is meant to hold, and those below which it isn't worth a task.
ROWS = 1_000_000
SMALL_RANGE = 10_000
#: Working columns begin like this.
_ID = "_ordered"
PRUNED_TOP = 1000  # row_number() <= n is cut down before the shuffle up to this n


def top_per_group(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[Column],
    n: int | Column,
    name: str = "position",
    salt: Column | None = None,
) -> DataFrame:
    """First ``n`` rows per key, with their 1-based position.

    Up to a thousand rows per key the filter on row_number is pushed below the shuffle,
    so a hot key sends at most n rows per task. For more, or for a per-row ``n``, rows
    are first ranked within (key, salt) and only each salt's first n go on.
    """
    small = isinstance(n, int) and n <= PRUNED_TOP
    if not small:
        if salt is None:
            raise ValueError("a large or computed n needs a salt column")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        split = Window.partitionBy(*keys, F.pmod(F.xxhash64(salt), F.lit(parts))).orderBy(*order)
        df = df.withColumn(name, F.row_number().over(split)).filter(F.col(name) <= n).drop(name)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= n)


def in_order(df: DataFrame, order: Sequence[Column], name: str, rows: int = ROWS) -> DataFrame:
    """Rows with their 0-based place in the whole order, in ranges of about ``rows`` rows.

    The number of ranges follows the count, so ranges keep their size however large the
    table or one of its keys is. Each range is sorted alone and written once; a row's place
    is its place in the range plus the rows of the ranges before. Rows equal in ``order``
    must be alike. The written table stays in the shared folder, for the result reads it.
    """
    spark = df.sparkSession
    n = df.count()
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SMALL_RANGE))
    ranges = max(1, math.ceil(n / rows), spread)
    path = fresh_path(spark, "ordered")
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed.withColumn(_ID, F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(placed.withColumn(_ID, F.lit(0).cast("bigint")).schema).parquet(path)
    # The id holds the number of the range above its lowest 33 bits.
    number = F.shiftright(_ID, 33)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(number.alias("part")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(sizes)
    before = [0, *accumulate(sizes[p] for p in parts)]
    # One row a range, so its size is known and bounded by the count above.
    shifts = spark.createDataFrame([((p << 33), b) for p, b in zip(parts, before)], f"{_ID}_first long, {_ID}_before long")
    found = placed.join(shifts, F.shiftleft(number, 33) == F.col(f"{_ID}_first"))
    place = F.col(_ID) - F.col(f"{_ID}_first") + F.col(f"{_ID}_before")
    return found.withColumn(name, place).drop(_ID, f"{_ID}_first", f"{_ID}_before")


def with_position(
    df: DataFrame, keys: Sequence[str], first: Column, second: Column, name: str = "position", total: str | None = None, rows: int = ROWS
) -> DataFrame:
    """1-based position of every row within ``keys``, ordered by (first, second).

    Rows are placed in the order (keys, first, second), in which a key is one stretch, and
    the key's start is taken off: a key with a third of the table is spread over as many
    ranges as its rows need. ``second`` must tell rows with equal ``first`` apart. With
    ``total`` the key's number of rows comes along. Null keys are a key of their own.
    """
    placed = in_order(df, [*[quoted(k) for k in keys], first, second], f"{_ID}_place", rows)
    stretch = placed.groupBy(*[quoted(k).alias(f"{_ID}_k{i}") for i, k in enumerate(keys)]).agg(
        F.min(f"{_ID}_place").alias(f"{_ID}_start"), F.count(F.lit(1)).alias(f"{_ID}_total")
    )
    # Written, so that Spark knows the size of the table of keys before it plans the join.
    path = fresh_path(df.sparkSession, "stretches")
    stretch.write.parquet(path)
    stretch = df.sparkSession.read.schema(stretch.schema).parquet(path)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"{_ID}_k{i}"))
    found = placed.join(stretch, same).withColumn(name, F.col(f"{_ID}_place") - F.col(f"{_ID}_start") + 1)
    if total:
        found = found.withColumn(total, F.col(f"{_ID}_total"))
    return found.drop(f"{_ID}_place", f"{_ID}_start", f"{_ID}_total", *[f"{_ID}_k{i}" for i in range(len(keys))])
