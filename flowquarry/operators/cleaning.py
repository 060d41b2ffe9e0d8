"""Schema alignment, missing-value policies and label hygiene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import LEAKAGE_COLUMNS, quoted
from flowquarry.functions.numeric import finite_or_null, to_double
from flowquarry.operators.heavy_hitters import modes
from flowquarry.operators.order_statistics import quantile_table

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, text columns)."""
    numeric = [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    return numeric, [c for c, t in df.dtypes if t == "string"]


def drop_leakage(df: DataFrame, use: str = "training") -> DataFrame:
    return df.drop(*LEAKAGE_COLUMNS[use])


def reindex(df: DataFrame, expected: Sequence[str], fill: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``keep`` + ``expected``, in that order; absent columns hold ``fill``."""
    present = set(df.columns)
    return df.select(
        *[quoted(c) for c in keep],
        *[quoted(c) if c in present else F.lit(fill).alias(c) for c in expected],
    )


def align_splits(train: DataFrame, *others: DataFrame, keep: Sequence[str] = ()) -> list[DataFrame]:
    """Give every split the train split's columns and order."""
    expected = [c for c in train.columns if c not in keep]
    return [reindex(d, expected, keep=keep) for d in (train, *others)]


def sanitize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text becomes numbers and infinities and NaN become null, in one projection."""
    return df.withColumns({c: finite_or_null(to_double(quoted(c))) for c in columns})


def fill_values(df: DataFrame, values: dict[str, object]) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(v)) for c, v in known.items()})


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {r["feature"]: r["value"] for r in quantile_table(df, columns, 0.5).collect()}


def impute_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill gaps with the exact median; fit on the training split where one is given."""
    clean = sanitize(df, columns)
    fitted = clean if fit_on is None else sanitize(fit_on, columns)
    return fill_values(clean, median_values(fitted, columns))


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties, from summaries of bounded size."""
    types = dict(df.dtypes)
    return modes(df, {c: "double" if types[c] in NUMERIC else "string" for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return fill_values(df, mode_values(df if fit_on is None else fit_on, columns))


def drop_high_cardinality(df: DataFrame, limit: int = 50) -> DataFrame:
    """Drop text columns with more than ``limit`` distinct values."""
    _, text = columns_by_type(df)
    if not text:
        return df
    counts = df.agg(*[F.count_distinct(quoted(c)).alias(c) for c in text]).collect()[0]
    return df.drop(*[c for c in text if counts[c] > limit])


def impact_value(value: Column, fallback: Column) -> Column:
    """Absolute impact from the first present candidate; zero where unusable."""
    number = F.abs(to_double(F.coalesce(value, fallback)))
    return F.coalesce(finite_or_null(number), F.lit(0.0))
