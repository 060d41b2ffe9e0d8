"""Repeatable pseudo-random keys: a row's place in any shuffle, sample or split depends
only on its own id, never on partitioning or on retries of a lost task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32


def hash_word(key: Column, word: int = 0) -> Column:
    """Unsigned 32-bit word number ``word`` (0..3) of the md5 of ``key``, as bigint."""
    digest = F.md5(key.cast("string").cast("binary"))
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def hash_unit(key: Column, word: int = 0) -> Column:
    """A number in [0, 1) from ``key``."""
    return hash_word(key, word) / F.lit(float(WORD))


def fast_unit(*parts: Column) -> Column:
    """A number in [0, 1) from several parts, by Spark's own 64-bit hash: for draws no
    other engine has to repeat."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def hash_word_sql(key: str, word: int = 0) -> str:
    """The same word in the oracle's dialect."""
    return f"cast('0x' || substr(md5(cast({key} as varchar)), {1 + 8 * word}, 8) as bigint)"
