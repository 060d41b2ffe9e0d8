"""Helpers the language-data operators share: reading, batches of rows, materialised steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from flowquarry.session import shared_dir

#: Documents handed to a row function at once; texts are whole, whatever their length.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: str) -> pa.Schema:
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """Run a row function over lists of column values, a few hundred rows at a time.

    ``make`` is called once per task and returns a function from the columns (Python
    lists, in order) to result tuples. Nothing but the rows at hand is held in memory.
    """

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = work(*[c.to_pylist() for c in part.columns])
                columns = list(zip(*rows)) if rows else [[] for _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def settled(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
