"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. A source's target is its share by weight of all words, at most ``most``
times its own size; what is cut off goes to the others by weight until none is above.

Each source has a weight schedule over the training run, straight from ``start`` to ``end``
times its target density. Its integral says how many of its words the run has asked for at
time t; inverting that gives every document the time at which its words are reached. The
stream of a source is all its documents in the order of a hash, as often as the target asks:
a document is in pass e when the words before it, e whole passes included, are below the
target, and that copy's time is found from the same words before it, so that later passes come
when the schedule asks for them. Copies are range-sorted by their own times; ``mix`` has one row
per document with all its copies counted and the time of the first.

No source is handled by one task: hash ranges are summed first, their running sums joined
back, and only the documents of one range are ordered together.

Defined cases: a null text has size 0 and is taken as 0 words; a null source is a source of
its own, after the others; ties of the hash are ordered by id and size, so that equal rows
are interchangeable; documents outside the mix have position null and come last; extra
columns are ignored by ``mix`` and kept by ``mixed_documents``; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import settled, table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows that share a hash range of a source, about.
RANGE_ROWS = 4_000
#: Hexadecimal digits of the hash that tell ranges.
DIGITS = 7


def words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII spaces; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def _positions(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last, by range and offset."""
    ordered = sources.withColumn("_null", F.col("source").isNull())
    ranged = settled(ordered.repartitionByRange("_null", "source").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source"))
    return ranged.join(parts, "_part").select("source", "source_size", (F.col("_before") + inside - 1).alias("place"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    ``level`` words per unit of weight; sources whose bound lies below their share are fixed
    at it and the level is found anew, until no more are. Two sums go to the driver a round.
    """
    choices = F.array(*[F.lit(w) for w in weights])
    df = _positions(sources).withColumn("weight", F.element_at(choices, (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    df = settled(df.drop("place"))
    bound = F.col("source_size") * most
    total = df.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        at_bound = (bound <= level * F.col("weight")) if fixed >= 0 else F.lit(False)
        row = df.agg(
            F.sum(F.when(at_bound, bound).otherwise(0)).alias("words"),
            F.sum(F.when(at_bound, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(at_bound.cast("long")).alias("n"),
        ).first()
        if row.n is None or row.n == fixed or not row.weight:
            break
        fixed, level = row.n, (total - row.words) / row.weight
    target = F.when(bound <= level * F.col("weight"), bound.cast("double")).otherwise(level * F.col("weight"))
    return df.withColumn("target", target.cast("double"))


def time_of(demand: Column, start: float, end: float) -> Column:
    """When a share of a source's words is reached: the inverse of the schedule's integral.

    The density start + (end - start) t has the integral start t + (end - start) t^2 / 2; both
    are scaled to reach 1 at t = 1.
    """
    if start == end:
        return demand
    slope, area = end - start, (start + end) / 2
    return (F.sqrt(F.lit(start * start) + 2 * slope * area * demand) - start) / slope


def passes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
    schedules: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)), keep: bool = False,
) -> DataFrame:
    """Every document with its hash and the training positions of its copies, pass by pass.

    ``schedules`` repeat over weights: sources of weight 1 are asked for early, of weight 3
    late. ``keep`` carries the input columns along in one struct ``row``.
    """
    text = F.col(text_col)
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text).alias("size"), digest.alias("_digest")]
    if keep:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    docs = df.select(*cols)
    if not keep:
        docs = settled(docs)  # sizes and hashes only: texts are read once
    light = docs.select("source", "size", "_digest")
    rows = docs.count() if not keep else df.count()
    ranges = max(1, -(-rows // RANGE_ROWS))
    span = 16**DIGITS
    in_range = lambda d: F.floor(F.conv(F.substring(d, 1, DIGITS), 16, 10).cast("long") * ranges / span).cast("long")
    sums = settled(light.groupBy("source", in_range(F.col("_digest")).alias("_range")).agg(F.sum("size").alias("_words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    # At most `ranges` rows a source: one for some RANGE_ROWS of the table.
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    known = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(
        sums["source"].alias("_source"), F.col("_range").alias("_known"), "_before", "source_size", "weight", "target"
    )
    placed = docs.withColumn("_range", in_range(F.col("_digest")))
    inside = Window.partitionBy("source", "_range").orderBy("_digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(known, placed["source"].eqNullSafe(known["_source"]) & (F.col("_range") == F.col("_known")))
    start = F.col("_before") + F.col("_inside")
    def position(e: int) -> Column:
        share = F.least(F.try_divide(start + F.col("source_size") * e, F.col("target")), F.lit(1.0))
        when = F.lit(None).cast("double")
        for k, (a, b) in reversed(list(enumerate(schedules))):
            when = F.when((F.col("weight") - 1) % len(schedules) == k, time_of(share, a, b)).otherwise(when)
        return when

    # Pass e takes a document whose middle, after e whole passes, is still wanted.
    middle = start + F.col("size") / 2
    taken = [F.when((F.col("size") > 0) & (middle + F.col("source_size") * e < F.col("target")), position(e)) for e in range(most)]
    positions = F.array_compact(F.array(*taken)).alias("positions")
    return placed.select("doc_id", "size", "source_size", "target", positions, *(["row"] if keep else []), "_digest")


def mix(df: DataFrame, **options) -> DataFrame:
    """Sizes, targets, words taken, copies and first training position of every document, by position.

    Options are those of ``passes``.
    """
    copies = F.size("positions")
    result = passes(df, **options).withColumns({"taken": F.col("size") * copies, "copies": copies, "position": F.get("positions", F.lit(0))})
    kept = [c for c in result.columns if c == "row"]
    result = result.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", *kept, "_digest")
    return result.orderBy(F.col("position").asc_nulls_last(), "_digest").drop("_digest")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, as often as it takes them, each copy at its own position."""
    copies = passes(df, keep=True, **options).select(F.explode("positions").alias("position"), "_digest", "row")
    return copies.orderBy("position", "_digest").select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, coalesce(sum(source_size * 3) OVER w, 0) AS fixed_words, coalesce(sum(weight) OVER w, 0) AS fixed_weight,
  sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM p
  WINDOW w AS (ORDER BY source_size * 3.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT CAST(total - fixed_words AS DOUBLE) / (weights - fixed_weight) AS level FROM r
  WHERE source_size * 3 > CAST(total - fixed_words AS DOUBLE) / (weights - fixed_weight) * weight OR total = 0
  ORDER BY source_size * 3.0 / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, weight, CASE WHEN source_size * 3 <= level * weight THEN CAST(source_size * 3 AS DOUBLE) ELSE level * weight END AS target
  FROM p, l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, d.digest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(start + size / 2 < target AS INT) + CAST(start + size / 2 + source_size < target AS INT)
  + CAST(start + size / 2 + source_size * 2 < target AS INT) END AS copies FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies,
  CASE WHEN copies = 0 THEN NULL WHEN weight = 1 THEN (sqrt(2.25 + -2.0 * least(start / target, 1.0)) - 1.5) / -1.0
    WHEN weight = 2 THEN least(start / target, 1.0) ELSE (sqrt(0.25 + 2.0 * least(start / target, 1.0)) - 0.5) / 1.0 END AS position
FROM n
"""


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source."""
    return mix(table(spark, sf_dir, "documents"))


QUERY = op7_curriculum_mix
