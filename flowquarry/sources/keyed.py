"""A kept table in parts by its key, of which a change rewrites only the parts it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


class KeyedTable:
    """Parquet files under ``path``, one folder per part of the key's hash.

    ``parts`` is chosen when the table is made, so that a part is a comfortable file; a part's
    rows come and go together. Each rewrite is staged by Spark and put in place when its job
    commits, so a lost executor leaves the old files.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 200):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts

    def with_part(self, df: DataFrame) -> DataFrame:
        # One type for the hash, whatever integer type a change's key has.
        return df.withColumn(PART, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int"))

    def create(self, df: DataFrame) -> None:
        self.with_part(df).repartition(PART).write.partitionBy(PART).parquet(self.path)

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop(PART)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the parts that hold ``keys`` by what ``change`` makes of their rows.

        ``change`` sees those parts' rows alone and must return rows of the same columns whose
        keys are among ``keys`` or the rows it was given: inserts, updates and deletions alike.
        The touched part numbers, at most ``parts``, are the only thing the driver collects.
        """
        touched = sorted(r[0] for r in self.with_part(keys.select(self.key)).select(PART).distinct().collect())
        if not touched:
            return []
        stored = self.stored()
        old = stored.filter(F.col(PART).isin(touched))
        new = self.with_part(change(old.drop(PART)).select(*[c for c in stored.columns if c != PART]))
        present = {r[0] for r in new.select(PART).distinct().collect()}
        if not present <= set(touched):
            raise ValueError(f"the change made rows of parts {sorted(present - set(touched))}, which its keys do not touch")
        writer = new.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PART).parquet(self.path)
        nothing = self.spark.createDataFrame([], stored.drop(PART).schema)
        for part in touched:  # a part that lost all its rows gets a file without any
            if part not in present:
                nothing.write.mode("overwrite").parquet(f"{self.path}/{PART}={part}")
        return touched
