"""Exact k nearest neighbours between two distributed tables.

Points are cut into cells around sampled pivots. A query first meets one tile of its own
cell, whose k-th distance is a bound, and then only visits cells whose ball and box can beat
it. Cells are cut further into tiles of bounded size and the queries of a tile into chunks,
so a task always holds one tile and one chunk however dense a cell is. Within a task a tile
is cut into small parts by the same rule, so a query looks at few points where the data has
structure. Only the k best of each tile leave the task; no pair table exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.hashing import hash_word
from flowquarry.operators.positions import PRUNED_TOP, top_per_group
from flowquarry.session import fresh_path

MAX_BLOCKS = 1_000
MAX_PIVOTS = 64
TILE = 4_096
#: Queries that meet a tile in one task; every point is sent once a chunk of the queries that visit its cell.
CHUNK = 32_768
#: Queries whose visits are made at once.
VISITORS = 256
SLICE = 256
#: Points of a part of a tile.
PART = 64


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, one dimension at a time: small memory, stable order of sums."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _box_gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance to boxes, with the order of sums of :func:`_distances`: never above that of a point in it."""
    total = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0)
        total += gap * gap
    return np.sqrt(total)


def _loose(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9) + 1e-9


def _parts(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points in small parts around some of them; one part if any is not finite."""
    if len(points) <= 2 * PART or not np.isfinite(points).all():
        return [np.arange(len(points))]
    pivots = points[:: max(1, len(points) // max(1, len(points) // PART))]
    part = np.concatenate([_distances(points[i : i + SLICE], pivots).argmin(axis=1) for i in range(0, len(points), SLICE)])
    return [rows for rows in (np.flatnonzero(part == i) for i in range(len(pivots))) if len(rows)]


def tile_search(
    qid: np.ndarray, qvec: np.ndarray, limit: np.ndarray, pid: np.ndarray, pvec: np.ndarray, k: int, same_table: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, query of each hit, point, distance) in slices: the k best points by distance and place.

    Points further than a query's ``limit`` may be left out.
    """
    parts = _parts(pvec)
    low, high = (np.array([f(pvec[rows], axis=0) for rows in parts]) for f in (np.min, np.max))
    gaps = [_box_gap(qvec[i : i + SLICE], low, high) for i in range(0, len(qvec), SLICE)]
    # Queries of one part are looked at together.
    order = np.argsort(np.concatenate([g.argmin(axis=1) for g in gaps]), kind="stable")
    for start in range(0, len(order), SLICE):
        at = order[start : start + SLICE]
        ids, x, bound = qid[at], qvec[at], limit[at].copy()
        gap = _box_gap(x, low, high)
        home = gap.argmin(axis=1)
        hits: list[tuple] = []

        def meet(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            d = _distances(x[who], pvec[rows])
            if same_table:
                d[ids[who][:, None] == pid[rows][None, :]] = np.inf
            q, p = np.nonzero((d <= _loose(bound[who])[:, None]) & np.isfinite(d))
            hits.append((who[q], rows[p], d[q, p]))
            return d

        for i in np.unique(home):
            who = np.flatnonzero(home == i)
            d = meet(who, parts[i])
            if d.shape[1] >= k:
                bound[who] = np.fmin(bound[who], np.partition(d, k - 1, axis=1)[:, k - 1])
        near = ~(gap > _loose(bound)[:, None])
        near[np.arange(len(at)), home] = False
        for i in np.flatnonzero(near.any(axis=0)):
            meet(np.flatnonzero(near[:, i]), parts[i])
        q, p, d = (np.concatenate(c) for c in zip(*hits))
        # Exactly k by distance and id: points come by id.
        first = np.lexsort((p, d, q))
        q, p, d = q[first], p[first], d[first]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        yield at, at[q[kept]], p[kept], d[kept]


def nearest(
    queries: DataFrame, points: DataFrame, k: int, same_table: bool = False, tile: int = TILE, chunk: int = CHUNK
) -> DataFrame:
    """(qid, pid, distance, position): the k nearest points of each query's own block.

    Both tables hold (id, block, vec). Ties go to the smaller id. With ``same_table`` a
    row is not its own neighbour. Blocks are classes: few, of any size.
    """
    spark = points.sparkSession
    qtype, ptype, btype = dict(queries.dtypes)["id"], dict(points.dtypes)["id"], dict(points.dtypes)["block"]
    counts = {r["block"]: r["n"] for r in points.groupBy("block").agg(F.count("*").alias("n")).limit(MAX_BLOCKS + 1).collect()}
    if len(counts) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks")

    # Cells of about two tiles beyond the first few; sending stays within what one tile each would cost.
    most = {b: min(PRUNED_TOP, max(MAX_PIVOTS, math.ceil(n / (2 * tile)))) for b, n in counts.items()}
    wanted = {b: min(most[b], max(1, math.ceil(math.sqrt(n) / 4))) for b, n in counts.items()}
    sampled = top_per_group(points, ["block"], [hash_word(F.col("id")), F.col("id")], max(wanted.values(), default=1)).collect()
    pivots: dict = {}
    for r in sorted(sampled, key=lambda r: r["position"]):
        if r["position"] <= wanted[r["block"]]:
            pivots.setdefault(r["block"], []).append(r["vec"])
    shared = spark.sparkContext.broadcast({b: np.array(v, dtype=np.float64) for b, v in pivots.items()})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), dtype=np.int32)
            away = np.zeros(len(pdf))
            for block, rows in pdf.groupby("block", sort=False).indices.items():
                for start in range(0, len(rows), VISITORS):
                    part = rows[start : start + VISITORS]
                    d = _distances(_matrix(pdf["vec"].iloc[part]), shared.value[block])
                    cell[part] = d.argmin(axis=1)
                    away[part] = d.min(axis=1)
            yield pdf.assign(cell=cell, away=away)

    celled = points.mapInPandas(assign, f"id {ptype}, block {btype}, vec array<double>, cell int, away double")

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (block, cell), rows in pdf.groupby(["block", "cell"], sort=False).indices.items():
                x = _matrix(pdf["vec"].iloc[rows])
                yield pd.DataFrame({
                    "block": [block], "cell": [cell], "n": [len(rows)], "radius": [pdf["away"].to_numpy()[rows].max()],
                    "low": [x.min(axis=0)], "high": [x.max(axis=0)],
                })

    each = celled.mapInPandas(boxes, f"block {btype}, cell int, n long, radius double, low array<double>, high array<double>")
    stats: dict = {}
    width = F.posexplode(F.arrays_zip("low", "high"))
    sides = each.select("block", "cell", "n", "radius", width.alias("j", "side")).groupBy("block", "cell", "j").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("side.low").alias("low"), F.max("side.high").alias("high")
    )
    for r in sorted(sides.filter("block IS NOT NULL").collect(), key=lambda r: (r["cell"], r["j"])):
        held = stats.setdefault(r["block"], {}).setdefault(r["cell"], (r["n"], r["radius"], [], []))
        held[2].append(r["low"])
        held[3].append(r["high"])
    # Of each block its cells' numbers, counts, radii and boxes.
    cells = {b: tuple(np.array(c, dtype=np.float64) for c in zip(*[(c, *v[c]) for c in v])) for b, v in stats.items()}
    sizes = spark.sparkContext.broadcast(cells)
    need = k + (1 if same_table else 0)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, rows in pdf.groupby("block", sort=False).indices.items():
                if block not in sizes.value:
                    continue
                number, _, radius, *_ = sizes.value[block]
                number = number.astype(np.int32)
                for start in range(0, len(rows), VISITORS):
                    part = pdf.iloc[rows[start : start + VISITORS]]
                    d = _distances(_matrix(part["vec"]), shared.value[block][number])
                    yield part.assign(cell=number[np.where(np.isfinite(radius), d, np.inf).argmin(axis=1)])

    qschema = f"id {qtype}, block {btype}, vec array<double>"
    homed = queries.select("id", "block", "vec").mapInPandas(homes, f"{qschema}, cell int")

    def met(left: DataFrame, search, schema: str) -> DataFrame:
        """Tiles with the queries that ask them, as many chunks of queries as there are queries for."""
        asked = {(r["block"], r["cell"]): r["count"] for r in left.groupBy("block", "cell").count().collect()}
        plan = [
            (b, int(c), max(1, math.ceil(n / tile)), max(1, math.ceil(asked.get((b, int(c)), 0) / chunk)))
            for b, held in cells.items()
            for c, n in zip(held[0], held[1])
        ]
        plan = spark.createDataFrame(plan, f"block {btype}, cell int, tiles int, chunks int")
        q = left.join(plan, ["block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        # The first meeting needs only one tile, the second all of them.
        q = q.withColumn("tile", every if "bound" in left.columns else F.pmod(F.xxhash64("id", F.lit(1)), F.col("tiles")).cast("int"))
        p = (
            celled.join(plan, ["block", "cell"])
            .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("id", "block", "vec", "cell", "tile", "chunk")
        )
        keys = ["block", "cell", "tile", "chunk"]
        return q.drop("tiles", "chunks").groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(search, schema)

    def first(_key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        """Queries with a bound on their k-th distance and the cells they visit."""
        bound = np.full(len(q), np.inf)
        if len(q) and len(p):
            p = p.sort_values("id")
            x = _matrix(q["vec"])
            for at, who, _, d in tile_search(q["id"].to_numpy(), x, bound.copy(), p["id"].to_numpy(), _matrix(p["vec"]), k, same_table):
                full = np.bincount(who, minlength=len(q))[at] >= k
                last = np.zeros(len(q))
                np.maximum.at(last, who, d)
                bound[at[full]] = last[at[full]]
        if not len(q):
            return q[["id", "block", "vec"]].assign(bound=bound, cells=pd.Series([], dtype=object))
        out = []
        number, count, radius, low, high = sizes.value[q["block"].iloc[0]]
        number = number.astype(np.int32)
        for start in range(0, len(q), VISITORS):
            part = q.iloc[start : start + VISITORS]
            x = _matrix(part["vec"])
            d = _distances(x, shared.value[part["block"].iloc[0]][number])
            # The k-th distance is at most the reach by which enough points are covered.
            order = np.argsort(d + radius, axis=1)
            covered = np.cumsum(count[order], axis=1)
            enough = np.minimum((covered < need).sum(axis=1), len(number) - 1)
            reach = np.take_along_axis(d + radius, order, axis=1)[np.arange(len(part)), enough]
            reach = np.where(covered[:, -1] < need, np.inf, reach)
            known = _loose(bound[start : start + VISITORS])[:, None]
            near = (d - radius <= _loose(reach)[:, None]) & ~(d - radius > known) & ~(_box_gap(x, low, high) > known)
            out.append([number[row] for row in near])
        return q[["id", "block", "vec"]].assign(bound=bound, cells=[c for part in out for c in part])

    def best(_key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(p):
            p = p.sort_values("id")
            pid, qid = p["id"].to_numpy(), q["id"].to_numpy()
            for _, who, at, d in tile_search(qid, _matrix(q["vec"]), q["bound"].to_numpy(), pid, _matrix(p["vec"]), k, same_table):
                found.append(pd.DataFrame({"qid": qid[who], "pid": pid[at], "distance": d}))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "pid": [], "distance": []})

    bounded = met(homed, first, f"{qschema}, bound double, cells array<int>")
    # Written, for it is counted before it is used.
    path = fresh_path(spark, "visits")
    bounded.write.parquet(path)
    visiting = spark.read.schema(bounded.schema).parquet(path).select("id", "block", "vec", "bound", F.explode("cells").alias("cell"))
    candidates = met(visiting, best, f"qid {qtype}, pid {ptype}, distance double")
    return top_per_group(candidates, ["qid"], [F.col("distance"), F.col("pid")], k)
