"""Categories to numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.operators.positions import in_order

MAX_CATEGORIES = 10_000


def unseen(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct test values that training never held."""
    return test.select(*columns).distinct().join(train.select(*columns).distinct(), list(columns), "left_anti")


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct non-null values; refused beyond a bound fit for a model."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} values; use code_table")
    return sorted(r[0] for r in rows)


def code_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes in sorted order, for columns of any cardinality.

    Values are placed in ranges whose number follows their count, so no task numbers them all.
    """
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return in_order(values, [F.col("value")], "code")


def encode(df: DataFrame, column: str, codes: DataFrame, output: str, unknown: int | None = None) -> DataFrame:
    """Join codes on; values without one get ``unknown``."""
    joined = df.join(codes.select(F.col("value").alias(column), F.col("code").alias(output)), column, "left")
    return joined if unknown is None else joined.withColumn(output, F.coalesce(output, F.lit(unknown)))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """A 0/1 column per known value; unknown and null rows are all zero."""
    name = prefix or column
    return df.withColumns({f"{name}_{v}": _flag(quoted(column) == v) for v in values})


def dummies(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One-hot with an extra column for missing values; the source column goes."""
    flagged = one_hot(df, column, values).withColumn(f"{column}_nan", quoted(column).isNull().cast("int"))
    return flagged.drop(column)


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")
