"""Most frequent values from mergeable summaries.

Each task keeps at most ``COUNTERS`` counters a column (Misra-Gries): when there are more, the
smallest kept count is taken from all and what falls to zero is dropped. A kept count is then
too low by at most what was taken, and a value without counter occurs at most that often. The
sums over tasks keep both promises, so only values whose upper bound reaches the best lower
bound can be a mode. Those are counted exactly, by rows that hold one of them. Where values are
so even that too many could be the mode, or one without counter could, the column is counted in
full instead. A task that has taken as much as its best counter holds stops counting such a
column and says only how many values it passed over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.features import quoted

COUNTERS = 1024
#: Values of a column that are counted one by one.
CANDIDATES = 256
#: Cuts after which a task looks whether its counters still tell values apart.
PATIENCE = 4
#: One object for all, so that it is one key.
NAN = float("nan")
SUMMARY = "c int, number double, text string, n long, taken long"


class Summary:
    """Counters of one column in one task."""

    def __init__(self, size: int):
        self.size, self.counts, self.taken, self.cuts = size, {}, 0, 0

    def add(self, values: pa.Array) -> None:
        if self.cuts >= PATIENCE and not self.counts:
            self.taken += len(values) - values.null_count
            return
        counted = pc.value_counts(values.drop_null())
        for value, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
            value = NAN if value != value else value
            self.counts[value] = self.counts.get(value, 0) + n
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
            self.taken += cut
            self.cuts += 1
            if self.cuts >= PATIENCE and max(self.counts.values(), default=0) <= self.taken:
                # What was kept becomes part of what may have been passed over.
                self.taken += max(self.counts.values(), default=0)
                self.counts = {}


def summaries(df: DataFrame, kinds: Sequence[str], size: int = COUNTERS) -> DataFrame:
    """(c, number, text, n, taken): the counters of every task; ``taken`` stands in rows of its own."""
    out = pa.schema([("c", pa.int32()), ("number", pa.float64()), ("text", pa.string()), ("n", pa.int64()), ("taken", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Summary(size) for _ in kinds]
        for batch in batches:
            for summary, column in zip(held, batch.columns):
                summary.add(column)
        for c, (summary, kind) in enumerate(zip(held, kinds)):
            values, n = list(summary.counts), len(summary.counts) + 1
            numbers = [*values, None] if kind == "double" else [None] * n
            texts = [*values, None] if kind == "string" else [None] * n
            columns = [[c] * n, numbers, texts, [*summary.counts.values(), 0], [0] * (n - 1) + [summary.taken]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, SUMMARY)


def modes(df: DataFrame, kinds: dict[str, str], size: int = COUNTERS) -> dict[str, object]:
    """Most frequent value of each column, the smallest on ties; None without values. ``kinds``
    says whether a column is read as double or string."""
    columns = list(kinds)
    # Adding zero makes one value of -0.0 and 0.0, as grouping does.
    read = [quoted(c).cast("double") + F.lit(0.0) if kinds[c] == "double" else quoted(c).cast("string") for c in columns]
    typed = df.select(*[e.alias(f"v{i}") for i, e in enumerate(read)])
    found = summaries(typed, [kinds[c] for c in columns], size).groupBy("c", "number", "text")
    found = found.agg(F.sum("n").alias("n"), F.sum("taken").alias("taken")).persist()
    bounds = found.groupBy("c").agg(F.max("n").alias("best"), F.sum("taken").alias("off"))
    limits = {r["c"]: (r["best"], r["off"]) for r in bounds.collect()}
    likely = found.join(bounds, "c").filter((F.col("n") > 0) & (F.col("n") + F.col("off") >= F.col("best")))
    numbered = {r["c"]: r["k"] for r in likely.groupBy("c").agg(F.count("*").alias("k")).collect()}
    few = [c for c, k in numbered.items() if k <= CANDIDATES and limits[c][1] < limits[c][0]]
    counts: dict[int, list] = {c: [] for c in few}
    for r in likely.filter(F.col("c").isin(few)).select("c", "number", "text", "n").collect() if few else []:
        counts[r["c"]].append((r["n"], r["number"] if r["text"] is None else r["text"]))
    found.unpersist()
    inexact = {c: [v for _, v in counts[c]] for c in few if limits[c][1]}
    counts |= _counted(typed, inexact, [kinds[c] for c in columns]) if inexact else {}
    result: dict[str, object] = dict.fromkeys(columns)
    for c, (best, off) in limits.items():
        if not best and not off:  # no values at all
            continue
        most = max((n for n, _ in counts.get(c, [])), default=0)
        if most > off:
            result[columns[c]] = min((v for n, v in counts[c] if n == most), key=_order)
        else:  # too many candidates, or a value without counter may be as frequent
            name = f"v{c}"
            whole = typed.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
            result[columns[c]] = whole.agg(F.min_by(name, F.struct(-F.col("n"), F.col(name)))).first()[0]
    return result


def _order(value):
    """NaN comes after all numbers."""
    return (value != value, value) if isinstance(value, float) else value


def _counted(typed: DataFrame, wanted: dict[int, list], kinds: list[str]) -> dict[int, list]:
    """Exact counts of the wanted values of each column; rows without any give nothing."""
    nothing = {"number": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    hits = []
    for c, values in wanted.items():
        value = nothing | {"number" if kinds[c] == "double" else "text": F.col(f"v{c}")}
        entry = F.struct(F.lit(c).alias("c"), *[v.alias(n) for n, v in value.items()])
        hits.append(F.when(F.col(f"v{c}").isin(values), entry))
    rows = typed.select(F.explode(F.array_compact(F.array(*hits))).alias("e")).groupBy("e.c", "e.number", "e.text").count()
    out: dict[int, list] = {c: [] for c in wanted}
    for r in rows.collect():
        out[r["c"]].append((r["count"], r["number"] if r["text"] is None else r["text"]))
    return out
