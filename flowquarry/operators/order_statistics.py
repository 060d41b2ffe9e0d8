"""Exact order statistics of distributed columns without sorting them.

A sketch brackets every wanted rank, exact counts confirm the bracket, and the bracket
is narrowed until few rows are left inside it. Each round is one map-side-combined
aggregation over all columns and groups at once; what reaches the driver is bounded by
(groups x columns x grid), never by the rows. Ties collapse into one value, so a value
held by a third of the rows ends the search instead of overloading a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 256
ACCURACY = 10_000
MAX_GROUPS = 10_000
_POINTS = [i / GRID for i in range(GRID + 1)]
# Rows left in a bracket before they are counted value by value and summed in order.
SMALL = 50_000
# A round without a sketch at hand costs two passes; brackets up to so many times that are counted instead.
LATER = 20


@dataclass
class _Bracket:
    """Values between lo and hi hold the wanted rank; ``below`` rows lie under them.

    The extremes themselves belong to the bracket at first; bounds that were counted
    since do not (``past_lo``, ``past_hi``).
    """

    rank: int
    lo: float | int | None = None
    hi: float | int | None = None
    below: int = 0
    inside: int = 0
    value: float | int | None = None
    past_lo: bool = False
    past_hi: bool = False

    @property
    def open(self) -> bool:
        return self.value is None


def _per_group(by: Column | None, values: dict, kind: str) -> Column:
    """The entry of ``values`` for the row's group, as a literal or a literal map."""
    if by is None:
        return F.lit(values[None]).cast(kind)
    pairs = [F.lit(x).cast(kind) if i % 2 else F.lit(x) for kv in values.items() for i, x in enumerate(kv)]
    return F.try_element_at(F.create_map(*pairs), by)


def _grouped(df: DataFrame, by: Column | None, aggs: list[Column]) -> dict:
    if by is None:
        return {None: df.agg(*aggs).collect()[0]}
    rows = df.groupBy(by.alias("_group")).agg(*aggs).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups; rank within them with positions.with_position")
    return {r["_group"]: r for r in rows if r["_group"] is not None}


def order_statistics(
    df: DataFrame,
    series: dict[str, Column],
    ranks: Callable[[object, str, int], Sequence[int]],
    by: Column | None = None,
    small: int = SMALL,
) -> dict[tuple[object, str], list[tuple[float | int, int, int, int] | None]]:
    """For every (group, series), the value at each wanted 1-based rank.

    ``ranks(group, name, n)`` names the ranks given the count of non-missing values.
    Each answer is (value, rows below it, rows equal to it, rank); None for rank 0 or a
    rank past the end. NaN counts as missing.
    """
    types = dict(df.select(*[c.alias(n) for n, c in series.items()]).dtypes)
    # NaN only exists in floating columns; missing values never take a rank.
    clean = {
        n: (F.when(~F.isnan(c), c) if types[n] in ("double", "float") else c) for n, c in series.items()
    }
    # One pass for counts, extremes and a first sketch of every series in every group.
    first = _grouped(
        df,
        by,
        [F.percentile_approx(c, _POINTS, ACCURACY).alias(f"p_{n}") for n, c in clean.items()]
        + [F.count(c).alias(f"n_{n}") for n, c in clean.items()]
        + [F.min(c).alias(f"lo_{n}") for n, c in clean.items()]
        + [F.max(c).alias(f"hi_{n}") for n, c in clean.items()],
    )
    state: dict[tuple[object, str], list[_Bracket | None]] = {}
    for g, row in first.items():
        for n in series:
            total = row[f"n_{n}"]
            state[g, n] = [
                _Bracket(k, row[f"lo_{n}"], row[f"hi_{n}"], 0, total) if 1 <= k <= total else None
                for k in ranks(g, n, total)
            ]
    _settle(state)

    sketch: dict | None = first
    while any(b and b.open and b.inside > (small if sketch else small * LATER) for bs in state.values() for b in bs):
        _narrow(df, by, clean, types, state, sketch)
        _settle(state)
        sketch = None
    _finish(df, by, clean, types, state)
    return {
        key: [None if b is None else (b.value, b.below, b.inside, b.rank) for b in brackets]
        for key, brackets in state.items()
    }


def _slots(state) -> dict[tuple[str, int], dict]:
    """Brackets arranged per (series, slot) and group."""
    slots: dict[tuple[str, int], dict] = {}
    for (g, n), brackets in state.items():
        for j, b in enumerate(brackets):
            if b is not None:
                slots.setdefault((n, j), {})[g] = b
    return slots


def _settle(state) -> None:
    for brackets in state.values():
        for b in brackets:
            if b and b.open and b.lo == b.hi and not (b.past_lo or b.past_hi):
                b.value = b.lo


def _open_slots(state) -> dict[tuple[str, int], dict]:
    slots = {key: {g: b for g, b in groups.items() if b.open} for key, groups in _slots(state).items()}
    return {key: groups for key, groups in slots.items() if groups}


def _inside(by, column: Column, groups: dict, kind: str) -> Column:
    """Whether a row's value lies in its group's bracket."""
    lo = _per_group(by, {g: b.lo for g, b in groups.items()}, kind)
    hi = _per_group(by, {g: b.hi for g, b in groups.items()}, kind)
    past_lo = _per_group(by, {g: b.past_lo for g, b in groups.items()}, "boolean")
    past_hi = _per_group(by, {g: b.past_hi for g, b in groups.items()}, "boolean")
    return ((column > lo) | ((column == lo) & ~past_lo)) & ((column < hi) | ((column == hi) & ~past_hi))


def _narrow(df, by, clean, types, state, whole) -> None:
    """Shrink every open bracket; ``whole`` is the sketch over all rows, while it applies.

    Two values inside the bracket are guessed around the rank, and rows are counted below,
    at and between them. The rank then lies at a guess, which ends the search however many
    rows share it, or in one of three smaller brackets without the guesses: a sketch that
    missed costs a round, and every round takes at least one value out.
    """
    slots = _open_slots(state)
    if whole is not None:
        points_of = lambda g, n, j: whole[g][f"p_{n}"]
    else:
        aggs = []
        for (n, j), groups in slots.items():
            held = F.when(_inside(by, clean[n], groups, types[n]), clean[n])
            aggs.append(F.percentile_approx(held, _POINTS, ACCURACY).alias(f"p_{n}_{j}"))
        sketched = _grouped(df, by, aggs)
        points_of = lambda g, n, j: sketched[g][f"p_{n}_{j}"]

    guesses: dict[tuple[str, int], dict] = {}
    for (n, j), groups in slots.items():
        for g, b in groups.items():
            points = points_of(g, n, j)
            wanted = (b.rank - b.below) / b.inside
            left = max(0, math.floor((wanted - 2 / ACCURACY) * GRID) - 1)
            right = min(GRID, math.ceil((wanted + 2 / ACCURACY) * GRID) + 1)
            guesses.setdefault((n, j), {})[g] = (points[left], points[right])

    counted = _counted_plain(df, clean, types, guesses) if _plain(by, types) else _counted(df, by, clean, types, guesses)
    for (n, j), groups in guesses.items():
        for g, (lo, hi) in groups.items():
            b, row = state[g, n][j], counted[g]
            below, at_lo, between, at_hi = (row[f"{c}_{n}_{j}"] for c in "blih")
            if b.rank <= below:
                b.hi, b.past_hi, b.inside = lo, True, below - b.below
            elif b.rank <= below + at_lo:
                b.value, b.below, b.inside = lo, below, at_lo
            elif b.rank <= below + at_lo + between:
                b.lo, b.hi, b.past_lo, b.past_hi = lo, hi, True, True
                b.below, b.inside = below + at_lo, between
            elif lo != hi and b.rank <= below + at_lo + between + at_hi:
                b.value, b.below, b.inside = hi, below + at_lo + between, at_hi
            else:
                under = below + at_lo + (between + at_hi if lo != hi else 0)
                b.lo, b.past_lo, b.inside = hi, True, b.below + b.inside - under
                b.below = under


def _counted(df, by, clean, types, guesses) -> dict:
    """Per group, the rows below, at and between the guesses of every slot."""
    aggs = []
    for (n, j), groups in guesses.items():
        lo = _per_group(by, {g: v[0] for g, v in groups.items()}, types[n])
        hi = _per_group(by, {g: v[1] for g, v in groups.items()}, types[n])
        aggs.append(F.count_if(clean[n] < lo).alias(f"b_{n}_{j}"))
        aggs.append(F.count_if(clean[n] == lo).alias(f"l_{n}_{j}"))
        aggs.append(F.count_if((clean[n] > lo) & (clean[n] < hi)).alias(f"i_{n}_{j}"))
        aggs.append(F.count_if(clean[n] == hi).alias(f"h_{n}_{j}"))
    return _grouped(df, by, aggs)


_INTEGERS = ("bigint", "int", "smallint", "tinyint")


def _plain(by, types) -> bool:
    """Whether numpy may count: numbers of the whole table, however many slots they have."""
    return by is None and all(t in ("double", "float", *_INTEGERS) for t in types.values())


def _wide(df, clean, types, names) -> DataFrame:
    return df.select(*[clean[n].cast("bigint" if types[n] in _INTEGERS else "double").alias(n) for n in names])


def _counted_plain(df, clean, types, guesses) -> dict:
    """The same counts from one search per value among all guesses of its series: a chain of
    comparisons per slot would outgrow what the JVM compiles."""
    points: dict[str, list] = {}
    for (n, _j), groups in guesses.items():
        points.setdefault(n, []).extend(groups[None])
    points = {n: np.unique(np.array(v, np.int64 if types[n] in _INTEGERS else np.float64)) for n, v in points.items()}

    def run(batches):
        totals = [np.zeros(2 * len(p) + 1, np.int64) for p in points.values()]
        for batch in batches:
            for column, p, total in zip(batch.columns, points.values(), totals):
                x = column.drop_null().to_numpy()
                place = np.searchsorted(p, x)
                # Even: between two points; odd: at one.
                total += np.bincount(2 * place + (p[np.minimum(place, len(p) - 1)] == x), minlength=len(total))
        for s, total in enumerate(totals):
            yield pa.RecordBatch.from_pydict({"s": np.full(len(total), s), "code": np.arange(len(total)), "n": total})

    rows = _wide(df, clean, types, points).mapInArrow(run, "s bigint, code bigint, n bigint")
    summed = {(r["s"], r["code"]): r["n"] for r in rows.groupBy("s", "code").agg(F.sum("n").alias("n")).collect()}
    row: dict[str, int] = {}
    under, at = {}, {}
    for s, (n, p) in enumerate(points.items()):
        total = 0
        for i, x in enumerate(p.tolist()):
            total += summed.get((s, 2 * i), 0)
            under[n, x], at[n, x] = total, summed.get((s, 2 * i + 1), 0)
            total += at[n, x]
    for (n, j), groups in guesses.items():
        lo, hi = groups[None]
        row[f"b_{n}_{j}"], row[f"l_{n}_{j}"], row[f"h_{n}_{j}"] = under[n, lo], at[n, lo], at[n, hi]
        row[f"i_{n}_{j}"] = under[n, hi] - under[n, lo] - at[n, lo] if lo < hi else 0
    return {None: row}


def _left_plain(df, clean, types, slots, wide) -> DataFrame:
    """(g, slot, x, target) of the values left in each bracket of the whole table."""
    left = [(n, j, groups[None]) for (n, j), groups in slots.items() if (types[n] in _INTEGERS) == (wide == "bigint")]
    names = list(dict.fromkeys(n for n, _, _ in left))

    def run(batches):
        for batch in batches:
            values = {n: c.drop_null().to_numpy() for n, c in zip(names, batch.columns)}
            for n, j, b in left:
                x = values[n]
                above = x > b.lo if b.past_lo else x >= b.lo
                x = x[above & (x < b.hi if b.past_hi else x <= b.hi)]
                if len(x):
                    yield pa.RecordBatch.from_pydict({"slot": [f"{n}\x00{j}"] * len(x), "x": x, "target": np.full(len(x), b.rank - b.below)})

    rows = _wide(df, clean, types, names).mapInArrow(run, f"slot string, x {wide}, target bigint")
    return rows.select(F.lit(None).cast("string").alias("g"), "slot", "x", "target")


def _finish(df, by, clean, types, state) -> None:
    """Pick the wanted value among the few rows left in each bracket."""
    slots = _open_slots(state)
    if not slots:
        return
    # One distributed value count per (group, slot) over the rows left, then a running sum.
    picks, inside = [], F.lit(False)
    for (n, j), groups in slots.items():
        target = _per_group(by, {g: b.rank - b.below for g, b in groups.items()}, "bigint")
        keep = _inside(by, clean[n], groups, types[n])
        inside = inside | keep
        wide = "double" if types[n] in ("double", "float") else "bigint"
        picks.append(
            (wide, F.when(keep, F.struct(
                F.lit(f"{n}\x00{j}").alias("slot"), clean[n].cast(wide).alias("x"), target.alias("target"))))
        )
    for wide in sorted({w for w, _ in picks}):
        group = (by if by is not None else F.lit(None).cast("string")).alias("g")
        if _plain(by, types):
            held = _left_plain(df, clean, types, slots, wide)
        else:
            # Few rows lie in a bracket: the others leave before an array is made for them.
            held = df.filter(inside).select(group, F.explode(F.array_compact(F.array(*[p for w, p in picks if w == wide]))).alias("e")).select("g", "e.*")
        rows = held.groupBy("g", "slot", "x", "target").count()
        w = Window.partitionBy("g", "slot").orderBy("x")
        found = (
            rows.withColumn("upto", F.sum("count").over(w))
            .filter((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("count") < F.col("target")))
            .collect()
        )
        for r in found:
            n, j = r["slot"].split("\x00")
            b = state[r["g"], n][int(j)]
            b.value, b.below, b.inside = r["x"], b.below + r["upto"] - r["count"], r["count"]


def discrete_rank(q: float, n: int) -> int:
    """Rank of the discrete q-quantile among n values."""
    return max(1, math.ceil(q * n)) if n else 0


def quantile_table(df: DataFrame, columns: Sequence[str], q: float = 0.5, by: str | None = None) -> DataFrame:
    """Exact discrete quantiles as rows (label, feature, value); label only with ``by``."""
    spark = df.sparkSession
    names = {f"c{i}": c for i, c in enumerate(columns)}
    found = order_statistics(
        df,
        {k: F.col(f"`{c}`").cast("double") for k, c in names.items()},
        lambda _g, _n, n: [discrete_rank(q, n)],
        None if by is None else F.col(by),
    )
    rows = [(g, names[k], None if v[0] is None else float(v[0][0])) for (g, k), v in found.items()]
    table = spark.createDataFrame(rows, "label string, feature string, value double")
    return table if by is not None else table.drop("label")


def cut_keys(
    df: DataFrame,
    order: Sequence[Column],
    ranks: Callable[[object, int], Sequence[int]],
    by: Column | None = None,
) -> dict[object, list[tuple | None]]:
    """Per group, the composite key of the row at each wanted rank in ``order``.

    Keys are found one column at a time: ties on a found value are resolved among the
    tied rows only, and a key ends with the column that leaves none. Comparing rows with
    the returned keys then splits the table row by row, with no shuffle of the data.
    """
    first = order_statistics(df, {"k": order[0]}, lambda g, _n, n: ranks(g, n), by)
    cuts: dict[object, list] = {
        g: [None if v is None else {"key": [v[0]], "left": v[3] - v[1], "ties": v[2]} for v in vs]
        for (g, _), vs in first.items()
    }
    for depth in range(1, len(order)):
        slots: dict[str, dict] = {}
        for g, cut_list in cuts.items():
            for j, cut in enumerate(cut_list):
                if cut is not None and cut["ties"] > 1:
                    slots.setdefault(f"s{j}", {})[g] = cut
        if not slots:
            break
        kinds = [t for _, t in df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).dtypes]
        series = {}
        for name, groups in slots.items():
            tied = F.lit(True)
            for i in range(depth):
                tied = tied & (order[i] == _per_group(by, {g: c["key"][i] for g, c in groups.items()}, kinds[i]))
            series[name] = F.when(tied, order[depth])
        found = order_statistics(
            df, series, lambda g, s, n: [slots[s][g]["left"]] if g in slots[s] and n else [], by
        )
        for name, groups in slots.items():
            for g, cut in groups.items():
                value, below, equal, _rank = found[g, name][0]
                cut["key"].append(value)
                cut["left"] -= below
                cut["ties"] = equal
    return {g: [None if c is None else tuple(c["key"]) for c in cs] for g, cs in cuts.items()}


def not_after(order: Sequence[Column], keys: dict[object, tuple | None], by: Column | None = None) -> Column:
    """True for rows at or before their group's cut key; false where the group has none."""
    held = {g: k for g, k in keys.items() if k is not None}
    if not held:
        return F.lit(False)
    result = F.lit(True)
    for i in reversed(range(len(order))):
        # Groups whose key is shorter are already decided: they pass on equality.
        longer = {g: k for g, k in held.items() if len(k) > i}
        if not longer:
            continue
        kind = "double" if any(isinstance(k[i], float) for k in longer.values()) else "bigint"
        cut = _per_group(by, {g: k[i] for g, k in longer.items()}, kind)
        here = (order[i] < cut) | ((order[i] == cut) & result)
        decided = [g for g in held if g not in longer]
        result = F.when(by.isin(decided), F.lit(True)).otherwise(here) if decided and by is not None else here
    if by is not None:
        result = by.isin(list(held)) & result
    return F.coalesce(result, F.lit(False))
