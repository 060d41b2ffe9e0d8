"""Flow-record CSV scans with lineage and labels from file names."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions import labels as L
from flowquarry.functions.features import FLOW_FEATURES

#: Bytes of a file read at once in search of its first line's end.
FIRST_BYTES = 64 * 1024


def flow_schema(features: Sequence[str] = FLOW_FEATURES, text: Sequence[str] = ()) -> T.StructType:
    """Doubles for every feature; ``text`` columns are read as written, to be cast later."""
    return T.StructType([T.StructField(f, T.StringType() if f in text else T.DoubleType()) for f in features])


def infer_schema(spark: SparkSession, root: str, share: float = 1.0, pattern: str = "*.csv") -> T.StructType:
    """Fallback where columns are unknown: inferred from all rows, unless a share is given."""
    reader = spark.read.option("header", True).option("inferSchema", True).option("samplingRatio", share)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root).schema


def first_line(path: str) -> str | None:
    """The first line of a file that is not blank, None if there is none; no more than that is read."""
    if path.startswith("file:"):
        store, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    held = b""
    with store.open_input_stream(inner) as stream:
        while True:
            more = stream.read(FIRST_BYTES)
            held = (held + more).lstrip(b"\r\n\t ")
            line = re.match(rb"[^\r\n]*(?=[\r\n])", held)
            if line or not more:
                return (line[0] if line else held).decode(errors="replace") or None


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                rows.append((path, True, first_line(path)))
            except (OSError, ValueError, NotImplementedError):  # a store only Spark can open
                rows.append((path, False, None))
        yield pd.DataFrame(rows, columns=["path", "opened", "line"]).astype({"opened": bool})


def file_headers(spark: SparkSession, root: str | list[str], names: Sequence[str], pattern: str = "*.csv") -> list[tuple[str, str | None]]:
    """(path, header line) of every file below ``root``; None where it names no wanted column.

    The files are listed without their content (empty ones left out), and workers read each one's first bytes. Files
    in a store that only Spark opens are read by Spark, as lines of which one per file remains.
    One row per file goes to the driver, which lists the files anyway. A missing root raises.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    found = listed.select("path").mapInPandas(_first_lines, "path string, opened boolean, line string").collect()
    lines = {r["path"]: r["line"] for r in found}
    closed = [r["path"] for r in found if not r["opened"]]
    if closed:
        text = spark.read.text(closed).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        text = text.filter((F.col("start") == 0) & (F.trim("value") != "")).withColumn("line", F.monotonically_increasing_id())
        read = {unquote(r["path"]).split(":", 1)[-1].lstrip("/"): r["header"] for r in text.groupBy("path").agg(F.min_by("value", "line").alias("header")).collect()}
        lines |= {p: read.get(p.split(":", 1)[-1].lstrip("/")) for p in closed}
    return [(path, line if line and any(n in line for n in names) else None) for path, line in lines.items()]


def scan_flows(
    spark: SparkSession, root: str | list[str], schema: T.StructType | None = None, name_contains: str | None = None,
    pattern: str = "*.csv",
) -> DataFrame | None:
    """All CSV files below ``root`` as one table with ``source_file`` and ``basename``;
    None if there is none, an error if ``root`` does not exist.

    Columns are found by the names in each file's own header, trimmed: files may hold them in
    another order, hold more of them, or lack some, which are null then. Values are read as
    text and cast; one that doesn't fit its type is null. ``name_contains`` prunes files by
    lower-case name before their rows are read.
    """
    schema = schema or flow_schema()
    groups: dict[str | None, list[str]] = {}
    for path, header in file_headers(spark, root, [f.name for f in schema.fields], pattern):
        if name_contains is None or name_contains.lower() in path.rsplit("/", 1)[-1].lower():
            groups.setdefault(header, []).append(path)
    parts = []
    for header in sorted(groups, key=lambda h: h or ""):
        present = [c.strip() for c in next(csv.reader([header.lstrip("\ufeff")]))] if header else [""]
        as_text = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(present))])
        df = spark.read.schema(as_text).option("header", True).csv(groups[header])
        columns = [
            (F.col(f"_c{present.index(f.name)}").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
        name = F.col("_metadata.file_name").alias("basename")
        parts.append(df.select(*columns, F.col("_metadata.file_path").alias("source_file"), name))
    return reduce(DataFrame.unionAll, parts) if parts else None


def with_labels(df: DataFrame, name: str = "basename", legacy: bool = True) -> DataFrame:
    """Protocol, Label and SubType from the file name; empty labels become MQTT."""
    c = F.col(name)
    return df.withColumns(
        {"Protocol": L.protocol_of(c), "Label": L.fill_label(L.label_of(c)), "SubType": L.subtype_of(c, legacy)}
    )


def scan_splits(spark: SparkSession, train_root: str, test_root: str, schema: T.StructType | None = None) -> DataFrame:
    """Both directories in one table with a ``split`` column."""
    parts = []
    for split, root in (("train", train_root), ("test", test_root)):
        df = scan_flows(spark, root, schema)
        if df is not None:
            parts.append(df.withColumn("split", F.lit(split)))
    if not parts:
        raise FileNotFoundError("no CSV file in either directory")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
