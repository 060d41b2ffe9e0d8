"""From raw documents to encoded training text, in five stages.

Every stage works on all the one before has kept and writes Parquet that the next one reads.
All but the last return the columns of ``documents``. Nulls, empty and very long texts,
repeated rows, empty tables and extra columns have the results the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowquarry.llm import byte_bpe, curriculum, secrets, simhash, toxicity
from flowquarry.llm.common import table
from flowquarry.session import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the classifier is trained on the labelled documents."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return simhash.representatives(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training position."""
    return curriculum.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding them again: one row per document taken."""
    return byte_bpe.encode_digests(docs, *byte_bpe.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Toxicity is a trained score, which SQL can't express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
