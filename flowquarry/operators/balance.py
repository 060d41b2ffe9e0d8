"""Synthetic minority rows: interpolation between a row and one of its class neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.functions.hashing import hash_unit, hash_word
from flowquarry.operators.neighbours import nearest
from flowquarry.operators.order_statistics import cut_keys, not_after


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def majority_targets(counts: dict) -> dict:
    """Every class up to the largest."""
    most = max(counts.values(), default=0)
    return {c: most for c, n in counts.items() if n < most}


def soft_targets(counts: dict, share: float = 0.25) -> dict:
    """Only classes below a share of the largest, up to that share."""
    target = int(max(counts.values(), default=0) * share)
    return {c: target for c, n in counts.items() if n < target}


def _seed_plan(df: DataFrame, key: str, label: str, counts: dict, targets: dict) -> DataFrame:
    """(key, copy): how often each minority row seeds a synthetic row. Copies are spread
    evenly; the remainder goes to the first rows in hash order, found as one cut key per
    class rather than by ranking the class."""
    need = {c: targets[c] - counts[c] for c in targets}
    order = [hash_word(F.col(key), 0), hash_word(F.col(key), 1)]
    by = F.col(label)
    cuts = cut_keys(df, order, lambda c, n: [need[c] % n], by)
    each = F.create_map(*[x for c in need for x in (F.lit(c), F.lit(need[c] // counts[c]))])
    extra = not_after(order, {c: keys[0] for c, keys in cuts.items()}, by).cast("int")
    copies = F.element_at(each, by) + extra
    return df.select(key, label, copies.cast("int").alias("_copies")).filter("_copies > 0").select(
        key, label, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")
    )


def synthetic_pairs(df: DataFrame, key: str, label: str, vec: Column, targets: dict, counts: dict, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pairs, neighbours): pairs are (key, label, copy, neighbour, u) for every synthetic row.

    Only rows that seed one look for neighbours, among all rows of their class.
    """
    minority = df.filter(F.col(label).isin(list(targets)))
    vectors = minority.select(F.col(key).alias("id"), F.col(label).alias("block"), vec.cast("array<double>").alias("vec"))
    plan = _seed_plan(minority, key, label, counts, targets)
    seeds = vectors.join(plan.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    neighbours = nearest(seeds, vectors, k, same_table=True)
    tag = F.concat_ws("#", F.col(key), F.col("copy"))
    have = F.create_map(*[x for c in targets for x in (F.lit(c), F.lit(min(k, counts[c] - 1)))])
    pick = (F.pmod(hash_word(tag, 0), F.greatest(F.lit(1), F.element_at(have, F.col(label)))) + 1).cast("int")
    drawn = plan.withColumns({"_pick": pick, "u": hash_unit(tag, 1)})
    chosen = neighbours.select(F.col("qid").alias(key), F.col("pid").alias("neighbour"), F.col("position").alias("_pick"))
    return drawn.join(chosen, [key, "_pick"]).select(key, label, "copy", "neighbour", "u"), neighbours


def smote(
    df: DataFrame, key: str, label: str, features: Sequence[str], targets: dict | None = None, k: int = 5
) -> DataFrame:
    """Synthetic rows (seed, copy, neighbour, u, label, features) that lift each class in
    ``targets`` (default: all, to the majority count) to its target. A class of one row
    has no neighbour and stays as it is."""
    counts = class_counts(df, label)
    targets = {c: t for c, t in (majority_targets(counts) if targets is None else targets).items() if counts[c] > 1}
    fields = [F.col(key), *[quoted(f) for f in features]]
    if not targets:
        return df.limit(0).select(F.col(key).alias("seed"), F.lit(0).alias("copy"), F.col(key).alias("neighbour"), F.lit(0.0).alias("u"), label, *fields[1:])
    pairs, _ = synthetic_pairs(df, key, label, F.array(*fields[1:]), targets, counts, k)
    a = df.select(F.col(key).alias("seed"), *[quoted(f).alias(f"_a{i}") for i, f in enumerate(features)])
    b = df.select(F.col(key).alias("neighbour"), *[quoted(f).alias(f"_b{i}") for i, f in enumerate(features)])
    joined = pairs.withColumnRenamed(key, "seed").join(a, "seed").join(b, "neighbour")
    return joined.select(
        "seed", "copy", "neighbour", "u", label,
        *[(F.col(f"_a{i}") + F.col("u") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f) for i, f in enumerate(features)],
    )


def smote_nc(
    df: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: dict[str, Sequence[str]], targets: dict | None = None, k: int = 5
) -> DataFrame:
    """SMOTE for mixed columns: a differing category adds the squared median of the numeric
    standard deviations to the squared distance, and a synthetic row takes each category
    by majority of the seed's neighbours (smallest on ties)."""
    counts = class_counts(df, label)
    targets = {c: t for c, t in (majority_targets(counts) if targets is None else targets).items() if counts[c] > 1}
    minority = df.filter(F.col(label).isin(list(targets)))
    spread = minority.agg(*[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(numeric)]).collect()[0]
    ordered = sorted(s or 0.0 for s in spread)
    middle = len(ordered) // 2
    penalty = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    # One-hot times penalty / sqrt(2): two differing entries add up to penalty squared.
    flags = [
        F.when(quoted(c) == v, penalty / 2**0.5).otherwise(0.0) for c, values in categorical.items() for v in values
    ]
    vec = F.array(*[quoted(c).cast("double") for c in numeric], *flags)
    pairs, neighbours = synthetic_pairs(df, key, label, vec, targets, counts, k)
    values = df.select(F.col(key).alias("pid"), *[quoted(c).alias(c) for c in categorical])
    around = neighbours.select("qid", "pid").join(values, "pid").groupBy(F.col("qid").alias("seed")).agg(
        *[F.mode(c, True).alias(c) for c in categorical]
    )
    a = df.select(F.col(key).alias("seed"), *[quoted(f).alias(f"_a{i}") for i, f in enumerate(numeric)])
    b = df.select(F.col(key).alias("neighbour"), *[quoted(f).alias(f"_b{i}") for i, f in enumerate(numeric)])
    joined = pairs.withColumnRenamed(key, "seed").join(a, "seed").join(b, "neighbour").join(around, "seed")
    return joined.select(
        "seed", "copy", "neighbour", "u", label,
        *[(F.col(f"_a{i}") + F.col("u") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f) for i, f in enumerate(numeric)],
        *categorical,
    )


def nearest_unlike(df: DataFrame, key: str, label: str, vec: Column, wanted) -> DataFrame:
    """(qid, pid, distance): for each row of another class, the closest ``wanted`` row."""
    rows = df.select(F.col(key).alias("id"), F.lit(0).alias("block"), vec.cast("array<double>").alias("vec"), F.col(label).alias("_label"))
    return nearest(
        rows.filter(F.col("_label") != wanted).drop("_label"), rows.filter(F.col("_label") == wanted).drop("_label"), 1
    ).drop("position")
