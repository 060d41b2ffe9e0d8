"""Order statistics, positions, splits and top-n against brute force, skew included."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import splits as P
from flowquarry.operators import windows as W
from flowquarry.operators.order_statistics import cut_keys, not_after, order_statistics, quantile_table
from flowquarry.operators import positions
from flowquarry.operators.positions import in_order, top_per_group, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, and a third of those one time."""
    rng = np.random.default_rng(7)
    n = 30_000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    t = rng.integers(0, 5_000, n)
    t[(key == 0) & (rng.random(n) < 0.4)] = 2_500
    pdf = pd.DataFrame({"key": key, "t": t, "id": rng.permutation(n), "x": np.round(rng.normal(0, 50, n), 3)})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_order_statistics_narrow_to_the_exact_value(skewed):
    pdf, df = skewed
    ranks = [1, 17, len(pdf) // 2, len(pdf)]
    found = order_statistics(df, {"x": F.col("x"), "t": F.col("t")}, lambda g, n, total: ranks, small=50)
    for name in ("x", "t"):
        ordered = np.sort(pdf[name].to_numpy())
        for rank, (value, below, equal, asked) in zip(ranks, found[None, name]):
            assert value == ordered[rank - 1] and asked == rank
            assert below == (ordered < value).sum() and equal == (ordered == value).sum()


def test_order_statistics_per_group(skewed):
    pdf, df = skewed
    found = order_statistics(df, {"x": F.col("x")}, lambda g, n, total: [total // 3, 0, total + 1], F.col("key"), small=20)
    for g, part in pdf.groupby("key"):
        first, none, past = found[g, "x"]
        assert first[0] == np.sort(part["x"].to_numpy())[len(part) // 3 - 1] and none is None and past is None


def test_missing_values_take_no_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (100.0,), (float("nan"),), (None,)], "x double")
    assert quantile_table(df, ["x"], 0.5).first()["value"] == 2.0
    empty = quantile_table(df.filter("x is null"), ["x"], 0.5).first()
    assert empty["value"] is None


def test_cut_keys_resolve_ties(skewed):
    pdf, df = skewed
    order = [F.col("t"), F.col("id")]
    cuts = cut_keys(df, order, lambda g, n: [int(n * 0.7)], F.col("key"))
    kept = df.filter(not_after(order, {g: k[0] for g, k in cuts.items()}, F.col("key"))).groupBy("key").count()
    got = {r["key"]: r["count"] for r in kept.collect()}
    want = {g: int(len(p) * 0.7) for g, p in pdf.groupby("key")}
    assert got == {g: n for g, n in want.items() if n}
    hot = pdf[pdf["key"] == 0].sort_values(["t", "id"]).iloc[int((pdf["key"] == 0).sum() * 0.7) - 1]
    assert cuts[0][0] == (hot["t"], hot["id"])


def test_positions_with_hot_key_and_hot_time(skewed):
    pdf, df = skewed
    got = with_position(df, ["key"], F.col("t"), F.col("id")).select("id", "position").toPandas().set_index("id")["position"]
    want = pdf.sort_values(["t", "id"]).groupby("key").cumcount() + 1
    want.index = pdf.loc[want.index, "id"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False, check_dtype=False)


def test_positions_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 3, 1), (None, 1, 2), (5, 9, 3), (5, None, 4)], "key int, t int, id int")
    got = {r["id"]: r["position"] for r in with_position(df, ["key"], F.col("t"), F.col("id")).collect()}
    assert got == {2: 1, 1: 2, 4: 1, 3: 2}


def test_positions_of_a_hot_key_over_many_ranges(skewed):
    pdf, df = skewed
    got = with_position(df, ["key"], F.col("t"), F.col("id"), total="n", rows=50).select("id", "position", "n").toPandas().set_index("id").sort_index()
    ordered = pdf.sort_values(["t", "id"])
    want = (ordered.groupby("key").cumcount() + 1).set_axis(ordered["id"]).sort_index()
    assert got["position"].tolist() == want.tolist()
    assert got["n"].tolist() == pdf.sort_values("id").groupby("key")["id"].transform("size").tolist()


def test_ranges_keep_their_size(spark, skewed, monkeypatch, tmp_path):
    # Ten times the rows give ten times the ranges, none far above the rows asked for.
    _, df = skewed
    monkeypatch.setattr(positions, "fresh_path", lambda _, name: str(tmp_path / f"{name}{len(list(tmp_path.iterdir()))}"))
    for copies in (1, 10):
        many = df.crossJoin(spark.range(copies).select(F.col("id").alias("copy")))
        placed = in_order(many, [F.col("key"), F.col("t"), F.col("id"), F.col("copy")], "place", rows=500)
        assert sorted(r["place"] for r in placed.select("place").collect()) == list(range(many.count()))
    for path in sorted(tmp_path.iterdir()):
        sizes = [r["n"] for r in spark.read.parquet(str(path)).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 3 * 500


def test_positions_of_nothing_and_of_odd_names(spark):
    empty = spark.createDataFrame([], "`a key` int, t int, id int")
    assert with_position(empty, ["a key"], F.col("t"), F.col("id"), total="n").columns == ["a key", "t", "id", "position", "n"]
    assert with_position(empty, ["a key"], F.col("t"), F.col("id")).count() == 0
    df = spark.createDataFrame([(1, 5, 1, "x"), (1, 4, 2, None)], "`a key` int, t int, id int, position string")
    got = {r["id"]: r["position"] for r in with_position(df, ["a key"], F.col("t"), F.col("id")).collect()}
    assert got == {2: 1, 1: 2}


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_group(skewed, n):
    pdf, df = skewed
    got = top_per_group(df, ["key"], [F.col("t").desc(), F.col("id")], n, salt=F.col("id")).groupBy("key").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    want = pdf.sort_values(["t", "id"], ascending=[False, True]).groupby("key").head(n).groupby("key")["id"].agg(["size", "sum"])
    assert {r["key"]: (r["n"], r["s"]) for r in got.collect()} == {k: tuple(v) for k, v in want.iterrows()}


def test_split_counts_are_exact(skewed):
    pdf, df = skewed
    split = P.stratified_split(df, "key", [F.col("t"), F.col("id")], {"train": 0.7, "val": 0.15, "test": 0.15})
    got = {(r["key"], r["split"]): r["count"] for r in split.groupBy("key", "split").count().collect()}
    for g, part in pdf.groupby("key"):
        n = len(part)
        first, second = int(n * 0.7), int(n * 0.85)
        assert got.get((g, "train"), 0) == first and got.get((g, "val"), 0) == second - first
        assert got.get((g, "test"), 0) == n - second


def test_published_split_sizes():
    # 2 750 665 rows: 70/15/15 gives the published sizes to the rounding of one row.
    n = 2_750_665
    assert (math.floor(n * 0.7), n - math.floor(n * 0.85)) == (1_925_465, 412_600)


@pytest.mark.parametrize("rows,full,blocks", [(9, 0, 0), (10, 1, 1), (11, 1, 1), (75, 7, 1), (84, 8, 1), (85, 8, 2)])
def test_windows_and_blocks_at_the_edges(spark, rows, full, blocks):
    df = spark.range(rows).select(F.lit(1).alias("key"), F.timestamp_seconds("id").alias("ts"), "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    windows = W.count_windows(df, ["key"], "ts", "id", 10, "label", ["id"]).collect()
    assert len(windows) == full and all(r["majority_label"] == "a" and len(r["id"]) == 10 for r in windows)
    assert W.row_blocks(df, ["key"], F.col("id"), F.col("id"), 75, 10).select("block_id").distinct().count() == blocks


def test_oversample_and_burst(spark):
    df = spark.createDataFrame([("Benign", "a"), ("DDoS", "b")], "label string, key string")
    assert P.oversample(df, F.col("label") == "Benign", 20).count() == 22
    rows = P.burst_order(df, "label", "key", ["DDoS", "DoS"]).orderBy("place").collect()
    assert [r["label"] for r in rows] == ["Benign", "DDoS"]


@pytest.mark.parametrize("values", [2, 10, 50])
def test_few_values_and_very_many_rows(spark, values):
    n = 1_000_000
    df = spark.range(n).select((F.col("id") % values).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert quantile_table(df, ["x"], q).first()["value"] == (math.ceil(q * n) - 1) // (n // values)
    found = order_statistics(df, {"x": F.col("x")}, lambda g, name, total: [1, total // 2, total // 2 + 1, total], F.col("g"), small=10)
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        ordered = np.sort(part["x"].to_numpy())
        for rank, (value, below, equal, _) in zip([1, len(part) // 2, len(part) // 2 + 1, len(part)], found[g, "x"]):
            assert value == ordered[rank - 1] and below == (ordered < value).sum() and equal == (ordered == value).sum()


def test_splits_by_day(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id"), (F.col("id") % 2).cast("string").alias("label"), (F.col("id") % 10).alias("day"))
    parts = P.stratified_split(df, "label", [F.col("day"), F.xxhash64("id")], {"train": 0.7, "val": 0.15, "test": 0.15})
    counts = {(r["label"], r["split"]): r["count"] for r in parts.groupBy("label", "split").count().collect()}
    assert counts == {(label, s): c for label in "01" for s, c in (("train", 350_000), ("val", 75_000), ("test", 75_000))}
    days = parts.groupBy("label", "split").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).collect()
    days = {(r["label"], r["split"]): (r["lo"], r["hi"]) for r in days}
    for label in "01":
        train, val, test = (days[label, s] for s in ("train", "val", "test"))
        assert train[0] == int(label) and test[1] == 8 + int(label) and train[1] <= val[0] and val[1] <= test[0]


def test_latest_and_majority_do_not_sort_their_input(spark):
    from flowquarry.operators import windows as W

    df = spark.range(1000).selectExpr("id % 7 as k", "id % 3 as v", "timestamp_seconds(id) as ts", "id")
    majority = W.majority_per_key(df, "k", "v", "ts", "id")
    latest = W.latest(df, "k", ["v"], [F.col("ts"), F.col("id")])
    for plan in (majority, latest):
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    # Every value is seen 47 or 48 times per key; the first seen wins a tie.
    rows = df.collect()
    for r in majority.collect():
        own = [x for x in rows if x["k"] == r["k"]]
        count = {v: sum(x["v"] == v for x in own) for v in range(3)}
        first = {v: min(x["id"] for x in own if x["v"] == v) for v in range(3)}
        assert r["majority_label"] == min(range(3), key=lambda v: (-count[v], first[v])) and r["n"] == max(count.values())


def test_many_ranks_are_counted_without_a_chain_of_comparisons(spark):
    from flowquarry.operators.order_statistics import order_statistics

    df = spark.range(2000).selectExpr("CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN double('NaN') ELSE exp((id * 7919 % 2000) / 100) END AS x", "id * 31 % 50 AS t")
    ranks = list(range(50, 1500, 50))
    got = order_statistics(df, {"x": F.col("x"), "t": F.col("t")}, lambda g, n, total: ranks, small=4)
    rows = df.collect()
    for name in ("x", "t"):
        held = sorted(r[name] for r in rows if r[name] is not None and r[name] == r[name])
        for (value, below, equal, rank), k in zip(got[None, name], ranks):
            assert (value, rank) == (held[k - 1], k)
            assert (below, equal) == (sum(v < value for v in held), held.count(value))


def test_a_split_is_evaluated_once_under_a_filter(spark):
    from flowquarry.functions.hashing import hash_word
    from flowquarry.operators.splits import stratified_split

    df = spark.range(500).selectExpr("cast(id as string) AS k", "cast(id % 3 as string) AS label")
    order = [hash_word(F.col("k"), 0), hash_word(F.col("k"), 1)]
    out = stratified_split(df, "label", order, {"train": 0.7, "val": 0.15, "test": 0.15}).filter("split <> 'test'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 2
    assert {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()} == {
        (c, s): n for c, total in (("0", 167), ("1", 167), ("2", 166)) for s, n in (("train", int(total * 0.7)), ("val", int(total * 0.85) - int(total * 0.7)))
    }
