"""Count windows, row blocks, latest state and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.positions import top_per_group, with_position


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def majority(label: str, order: Sequence[Column]) -> Column:
    """Most frequent label of a small group; the one seen first wins a tie."""
    seen = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(label).alias("l"))))
    labels = F.transform(seen, lambda s: s["l"])
    distinct = F.array_distinct(labels)
    scored = F.transform(
        distinct, lambda x, i: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("c"), i.alias("i"), x.alias("l"))
    )
    return F.array_min(scored)["l"]


def count_windows(df: DataFrame, keys: Sequence[str], ts: str, key: str, size: int, label: str, stacked: Sequence[str]) -> DataFrame:
    """Non-overlapping windows of exactly ``size`` rows per key; the remainder is dropped.

    Positions come from the skew-safe ranking, and a window holds ``size`` rows, so both
    steps stay balanced when one key has most of the rows. ``stacked`` columns become
    arrays in row order.
    """
    placed = with_position(df, keys, micros(F.col(ts)), F.col(key))
    window = F.floor((F.col("position") - 1) / size).alias("window_no")
    rows = F.sort_array(F.collect_list(F.struct("position", *[F.col(c) for c in stacked])))
    grouped = placed.groupBy(*keys, window).agg(
        F.count("*").alias("n"), majority(label, [F.col("position")]).alias("majority_label"), rows.alias("_rows")
    )
    return grouped.filter(F.col("n") == size).select(
        *keys, "window_no", "majority_label", *[F.col(f"_rows.{c}").alias(c) for c in stacked]
    )


def row_blocks(df: DataFrame, keys: Sequence[str], first: Column, second: Column, size: int, min_tail: int) -> DataFrame:
    """Rows with their 1-based ``block_id``; a last block under ``min_tail`` rows is dropped."""
    placed = with_position(df, keys, first, second, total="_total")
    block = F.floor((F.col("position") - 1) / size) + 1
    full = F.floor(F.col("_total") / size)
    tail = F.col("_total") % size
    return placed.withColumn("block_id", block).filter((F.col("block_id") <= full) | (tail >= min_tail)).drop("_total")


def packed_order(ts: Column, row_id: Column) -> Column:
    """(time, id) as one decimal that sorts alike. Aggregates keep it in a fixed-width
    buffer and hash, where a struct would make them sort their input. Ids are not negative."""
    packed = micros(ts).cast("decimal(19,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + row_id.cast("decimal(19,0)")
    return packed.cast("decimal(38,0)")


def majority_per_key(df: DataFrame, key: str, label: str, ts: str, row_id: str) -> DataFrame:
    """Most frequent label per key over any number of rows; first seen wins a tie.

    Counting by (key, label) combines before the shuffle, so a hot key is no burden.
    """
    seen = packed_order(F.col(ts), F.col(row_id))
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    best = top_per_group(counts, [key], [F.col("n").desc(), F.col("seen")], 1)
    return best.select(key, F.col(label).alias("majority_label"), "n")


def latest(df: DataFrame, key: str, values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The values of each key's last row; a group limit prunes before the shuffle."""
    return top_per_group(df, [key], [c.desc() for c in order], 1).select(key, *values)


def recent_rate(df: DataFrame, ts: str, asof: Column, span: str = "5 seconds", high: int = 10) -> DataFrame:
    """Rows in the trailing span up to ``asof``, and "high" above ``high`` rows."""
    inside = df.filter((F.col(ts) >= asof - F.expr(f"interval {span}")) & (F.col(ts) <= asof))
    return inside.agg(F.count("*").alias("n")).withColumn("status", rate_status(F.col("n"), high))


def rate_status(n: Column, high: int = 10) -> Column:
    return F.when(n > high, "high").otherwise("normal")
