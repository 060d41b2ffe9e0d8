"""Attribution of any score against a background sample: kernel and partition explainers.

Both choose coalitions of features once, for all rows, and both are linear in the coalitions'
values: ``phi = matrix @ values``. The matrix is settled on the driver from features alone; a
row's values are the mean scores over the background rows with the coalition's features taken
from the row. They are computed in Arrow batches, so there is no shuffle and a task holds one
slice of rows times the background.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted
from flowquarry.functions.hashing import hash_word

#: Rows of a background sample; more only sharpen the mean.
BACKGROUND_ROWS = 50
#: Coalitions a plan may have.
COALITIONS = 2048
#: Rows times background rows that are scored at once.
SCORED_AT_ONCE = 200_000


@dataclass
class Plan:
    """Coalitions (one row each, true where a feature comes from the row) and their weights."""

    masks: np.ndarray
    matrix: np.ndarray


def background_rows(df: DataFrame, key: str, features: Sequence[str], rows: int = BACKGROUND_ROWS) -> np.ndarray:
    """A repeatable sample: the complete rows whose key hashes lowest."""
    whole = df.dropna(subset=[quoted_name(f) for f in features]).select(key, *[quoted(f).cast("double") for f in features])
    first = whole.orderBy(hash_word(F.col(key), 0), hash_word(F.col(key), 1), key).limit(rows).collect()
    return np.array([[float(v) for v in r[1:]] for r in first]).reshape(len(first), len(features))


def quoted_name(feature: str) -> str:
    return f"`{feature}`"


# --- kernel explainer ----------------------------------------------------------------


def kernel_coalitions(n: int, budget: int = COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions and their Shapley kernel weights.

    Sizes are taken whole from both ends as long as the budget lasts; what the remaining sizes
    weigh is shared by pairs of a drawn coalition and its complement.
    """
    sizes = [(s, n - s) if s != n - s else (s,) for s in range(1, n // 2 + 1)]
    masks, weights = [], []
    left = budget
    while sizes and sum(math.comb(n, s) for s in sizes[0]) <= left:
        for s in sizes.pop(0):
            for chosen in combinations(range(n), s):
                masks.append([i in chosen for i in range(n)])
                weights.append((n - 1) / (math.comb(n, s) * s * (n - s)))
                left -= 1
    if sizes:
        rng = random.Random(seed)
        rest = [s for pair in sizes for s in pair]
        share = [(n - 1) / (s * (n - s)) for s in rest]
        drawn: dict[tuple[bool, ...], int] = {}
        for _ in range(max(left // 2, n)):
            chosen = set(rng.sample(range(n), rng.choices(rest, share)[0]))
            one = tuple(i in chosen for i in range(n))
            for mask in (one, tuple(not x for x in one)):
                drawn[mask] = drawn.get(mask, 0) + 1
        for mask, times in drawn.items():
            masks.append(list(mask))
            weights.append(sum(share) * times / sum(drawn.values()))
    return np.array(masks, bool).reshape(len(masks), n), np.array(weights)


def kernel_plan(n: int, budget: int = COALITIONS, seed: int = 42) -> Plan:
    """Weighted least squares whose parts add up to score(row) - mean score(background)."""
    if n == 1:
        return Plan(np.array([[False], [True]]), np.array([[-1.0, 1.0]]))
    z, w = kernel_coalitions(n, budget, seed)
    x = z.astype(float)
    inverse = np.linalg.pinv(x.T @ (w[:, None] * x))
    ones = np.ones(n)
    free = inverse @ (x.T * w)  # of the coalitions' gains over the background
    spread = inverse @ ones / (ones @ inverse @ ones)
    inner = free - np.outer(spread, ones @ free)
    masks = np.vstack([np.zeros((1, n), bool), np.ones((1, n), bool), z])
    return Plan(masks, np.column_stack([-spread - inner.sum(1), spread, inner]))


# --- partition explainer -------------------------------------------------------------


def correlation_tree(corr: np.ndarray):
    """Nested pairs of feature numbers: the closest groups join first.

    The distance of two features is 1 - |corr| (an undefined one counts as zero), that of two
    groups the largest between their members; equal distances go to the earlier features.
    """
    far = 1.0 - np.abs(np.nan_to_num(corr))
    groups = [((i,), i) for i in range(len(far))]
    while len(groups) > 1:
        _, a, b = min(
            (round(float(far[np.ix_(groups[a][0], groups[b][0])].max()), 12), a, b)
            for a in range(len(groups)) for b in range(a + 1, len(groups))
        )
        joined = (groups[a][0] + groups[b][0], (groups[a][1], groups[b][1]))
        groups = [g for i, g in enumerate(groups) if i not in (a, b)]
        groups.insert(a, joined)
    return groups[0][1]


def leaves(tree) -> list[int]:
    return [tree] if isinstance(tree, int) else leaves(tree[0]) + leaves(tree[1])


def partition_plan(tree, budget: int = COALITIONS, seed: int = 42) -> Plan:
    """Owen values down a tree: at each fork either branch may join first, with equal chance.

    A leaf's value is its mean effect over all ways in which the branches beside its path can
    be there or not. Where that takes more coalitions than the budget, orders of the whole tree
    are drawn, each with its reverse. Both ways the parts add up.
    """
    n = len(leaves(tree))
    place: dict[tuple[bool, ...], int] = {}
    rows: list[tuple[int, int, float]] = []

    def effect(leaf: int, before: frozenset[int], share: float) -> None:
        for held, sign in ((before | {leaf}, share), (before, -share)):
            mask = tuple(i in held for i in range(n))
            rows.append((leaf, place.setdefault(mask, len(place)), sign))

    def contexts(node, beside: list[frozenset[int]]) -> None:
        if not isinstance(node, int):
            contexts(node[0], [*beside, frozenset(leaves(node[1]))])
            contexts(node[1], [*beside, frozenset(leaves(node[0]))])
            return
        for there in range(1 << len(beside)):
            held = frozenset().union(*(g for i, g in enumerate(beside) if there >> i & 1))
            effect(node, held, 0.5 ** len(beside))

    def depths(node, depth: int = 0) -> list[int]:
        return [depth] if isinstance(node, int) else depths(node[0], depth + 1) + depths(node[1], depth + 1)

    def drawn(node, rng: random.Random) -> list[int]:
        if isinstance(node, int):
            return [node]
        first, second = (drawn(child, rng) for child in node)
        return first + second if rng.random() < 0.5 else second + first

    if sum(2.0**d for d in depths(tree)) <= budget:
        contexts(tree, [])
    else:
        rng = random.Random(seed)
        pairs = max(1, budget // (2 * n))
        for _ in range(pairs):
            order = drawn(tree, rng)
            for one in (order, order[::-1]):
                for step, leaf in enumerate(one):
                    effect(leaf, frozenset(one[:step]), 0.5 / pairs)
    matrix = np.zeros((n, len(place)))
    for leaf, column, share in rows:
        matrix[leaf, column] += share
    return Plan(np.array(list(place), bool), matrix)


# --- rows ----------------------------------------------------------------------------


def coalition_values(rows: np.ndarray, background: np.ndarray, masks: np.ndarray, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """(rows x coalitions): mean score over the background, features of the coalition from the row.

    A score that knows a shorter way to these means offers it as ``coalition_values``.
    """
    if hasattr(score, "coalition_values"):
        return score.coalition_values(rows, background, masks)
    out = np.empty((len(rows), len(masks)))
    step = max(1, SCORED_AT_ONCE // len(background))
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        for i, mask in enumerate(masks):
            mixed = np.where(mask, part[:, None, :], background[None, :, :])
            out[start : start + step, i] = score(mixed.reshape(-1, mixed.shape[2])).reshape(len(part), -1).mean(1)
    return out


def explained(
    df: DataFrame, key: str, features: Sequence[str], background: np.ndarray,
    score: Callable[[np.ndarray], np.ndarray], plan: Plan,
) -> DataFrame:
    """(key, part, phi) of every row by a plan. A row with a missing feature has null phi."""
    if not len(background):
        raise ValueError("the background sample has no complete row")

    def values(*series: pd.Series) -> pd.DataFrame:
        rows = np.column_stack([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        phi = np.full(rows.shape, np.nan)
        whole = ~np.isnan(rows).any(axis=1)
        phi[whole] = coalition_values(rows[whole], background, plan.masks, score) @ plan.matrix.T
        return pd.DataFrame({f"p{i}": phi[:, i] for i in range(len(features))})

    schema = ", ".join(f"p{i} double" for i in range(len(features)))
    scored = df.select(key, F.pandas_udf(values, schema)(*[quoted(f).cast("double") for f in features]).alias("_phi"))
    entries = [F.struct(F.lit(f).alias("part"), F.nanvl(F.col(f"_phi.p{i}"), F.lit(None)).alias("phi")) for i, f in enumerate(features)]
    return scored.select(key, F.inline(F.array(*entries)))


def kernel_shapley(
    df: DataFrame, key: str, features: Sequence[str], background: np.ndarray,
    score: Callable[[np.ndarray], np.ndarray], budget: int = COALITIONS, seed: int = 42,
) -> DataFrame:
    """(key, part, phi) by the kernel explainer; exact where all coalitions fit the budget."""
    return explained(df, key, features, background, score, kernel_plan(len(features), budget, seed))


def partition_shapley(
    df: DataFrame, key: str, features: Sequence[str], background: np.ndarray,
    score: Callable[[np.ndarray], np.ndarray], correlations: DataFrame, budget: int = COALITIONS, seed: int = 42,
) -> DataFrame:
    """(key, part, phi) by Owen values down the tree of the features' correlations.

    ``correlations`` has (a, b, corr) of each pair: features squared rows at most.
    """
    at = {f: i for i, f in enumerate(features)}
    corr = np.eye(len(features))
    for r in correlations.collect():
        corr[at[r["a"]], at[r["b"]]] = corr[at[r["b"]], at[r["a"]]] = np.nan if r["corr"] is None else r["corr"]
    return explained(df, key, features, background, score, partition_plan(correlation_tree(corr), budget, seed))
