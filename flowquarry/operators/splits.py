"""Splits, samples and oversampling. A split is fitted as a few cut keys per class and then
applied row by row, so the table itself is never shuffled or sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.features import computed_once
from flowquarry.functions.hashing import WORD, hash_word
from flowquarry.operators.order_statistics import cut_keys, not_after
from flowquarry.operators.positions import top_per_group


def stratified_split(
    df: DataFrame, label: str, order: Sequence[Column], shares: dict[str, float], output: str = "split"
) -> DataFrame:
    """Cut each class at floor(cumulative share * n) rows in ``order``.

    ``order`` is time for a time split or hash words for a random one; the numbers in it
    must tell all rows of a class apart. Each class is cut exactly, however large.
    """
    names = list(shares)
    edges, total = [], 0.0
    for name in names[:-1]:
        total = round(total + shares[name], 12)
        edges.append(total)
    by = F.col(label)
    # Order columns are computed once per row and pass, then only compared: a filter on the
    # split would otherwise hold a copy of them for every comparison.
    held = {f"_o{i}": c for i, c in enumerate(order)}
    keyed, columns = computed_once(df, held), [F.col(c) for c in held]
    cuts = cut_keys(keyed.select(label, *held), columns, lambda _g, n: [int(n * e) for e in edges], by)
    chain = F
    for j, name in enumerate(names[:-1]):
        chain = chain.when(not_after(columns, {g: keys[j] for g, keys in cuts.items()}, by), F.lit(name))
    return computed_once(keyed.drop(output), {output: chain.otherwise(F.lit(names[-1]))}).drop(*held)


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Fraction of rows chosen by their own key; the same rows on every run."""
    return df.filter(hash_word(F.col(key)) < int(fraction * WORD))


def shuffled_head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows of a global shuffle; each task keeps n candidates at most."""
    return df.orderBy(hash_word(F.col(key)), F.col(key)).limit(n)


def sample_per_class(df: DataFrame, label: str, key: str, benign: int, other: int) -> DataFrame:
    """``benign`` random Benign rows and ``other`` of each attack class, fewer if fewer exist."""
    order = [hash_word(F.col(key)), F.col(key)]
    first = top_per_group(df, [label], order, max(benign, other))
    return first.filter(F.col("position") <= F.when(F.col(label) == "Benign", benign).otherwise(other))


def first_per_class(df: DataFrame, label: str, order: Sequence[Column], benign: int, attack: int) -> DataFrame:
    """The first ``benign`` Benign rows and the first ``attack`` of each attack class that
    has that many."""
    first = top_per_group(df, [label], order, max(benign, attack))
    enough = F.count("*").over(Window.partitionBy(label)) >= attack
    is_benign = F.col(label) == "Benign"
    kept = first.withColumn("_enough", enough)
    return kept.filter(
        (is_benign & (F.col("position") <= benign)) | (~is_benign & F.col("_enough") & (F.col("position") <= attack))
    ).drop("_enough")


def oversample(df: DataFrame, condition: Column, copies: int) -> DataFrame:
    """Original rows plus ``copies`` more of those meeting the condition; ``copy`` numbers them."""
    last = F.when(condition, F.lit(copies)).otherwise(F.lit(0))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))


def burst_order(df: DataFrame, label: str, key: str, attacks: Sequence[str], benign: int = 10, attack: int = 5) -> DataFrame:
    """Benign bursts between attack bursts: for each attack class in turn ``benign`` Benign
    rows then ``attack`` of the class, and a closing Benign burst. Adds ``burst``,
    ``position`` within it and ``place`` in the whole sequence; classes without rows are skipped.
    """
    order = [hash_word(F.col(key)), F.col(key)]
    picked = top_per_group(df, [label], order, max(benign * (len(attacks) + 1), attack))
    counts = picked.groupBy(label).agg(F.count("*").alias("n")).collect()
    present = [a for a in attacks if any(r[label] == a for r in counts)]
    rounds = len(present) + 1
    n_benign = next((r["n"] for r in counts if r[label] == "Benign"), 0)
    per_round = min(benign, max(1, n_benign // rounds)) if n_benign else 0
    # Benign rows are dealt out in hash order, a fresh handful per round.
    turn = F.floor((F.col("position") - 1) / max(1, per_round)).cast("int")
    benign_rows = picked.filter((F.col(label) == "Benign") & (F.col("position") <= per_round * rounds)).withColumns(
        {"burst": turn * 2, "position": ((F.col("position") - 1) % max(1, per_round) + 1).cast("int")}
    )
    which = F.array_position(F.array(*[F.lit(a) for a in present]) if present else F.array(F.lit("")), F.col(label))
    attack_rows = picked.filter((F.col(label) != "Benign") & (F.col("position") <= attack) & (which > 0)).withColumn(
        "burst", ((which - 1) * 2 + 1).cast("int")
    )
    # At most a few dozen rows are left, so numbering them in one task is cheap.
    both = benign_rows.unionByName(attack_rows)
    return both.withColumn("place", F.row_number().over(Window.orderBy("burst", "position")))
