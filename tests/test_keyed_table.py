"""Changes of a kept table against the same change of all rows, and the files they leave."""

import os

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import relational as R
from flowquarry.sources.keyed import PART, KeyedTable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", parts=16)
    table.create(spark.range(200).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("SAFE").alias("status")))
    return table


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_update_insert_and_delete(spark, store):
    before, whole = files(store.path), rows(store.read())
    updates = spark.createDataFrame([(3, "ATTACK"), (77, "ATTACK"), (900, "ATTACK")], "id int, status string")
    touched = store.rewrite(updates, lambda old: R.apply_updates(old, updates, "id", ["status"]))
    want = [(i, n, "ATTACK" if i in (3, 77) else s) for i, n, s in whole]
    assert rows(store.read()) == want and 1 <= len(touched) <= 3
    after = files(store.path)
    parts = {f"{PART}={p}/" for p in touched}
    assert {f: t for f, t in before.items() if not any(p in f for p in parts)} == {f: t for f, t in after.items() if not any(p in f for p in parts)}
    assert not set(before) & {f for f in after if any(p in f for p in parts)}

    added = spark.createDataFrame([(500, "new", "SAFE"), (3, "again", "SAFE")], "id long, name string, status string")
    store.rewrite(added, lambda old: R.insert_missing(old, added, ["id"]))
    want = sorted([*want, (500, "new", "SAFE")])
    assert rows(store.read()) == want

    part = store.with_part(spark.createDataFrame([(3,)], "id long")).first()[PART]
    gone = store.stored().filter(F.col(PART) == part).select("id")
    ids = {r[0] for r in gone.collect()}
    store.rewrite(gone, lambda old: R.cascade(old, gone, "id"))
    assert rows(store.read()) == [r for r in want if r[0] not in ids] and 3 in ids


def test_changes_that_touch_nothing_or_too_much(spark, store):
    before = files(store.path)
    assert store.rewrite(spark.createDataFrame([], "id long"), lambda old: old) == [] and files(store.path) == before
    one = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError, match="do not touch"):
        store.rewrite(one, lambda old: old.unionByName(spark.range(300, 400).select("id", F.lit("x").alias("name"), F.lit("y").alias("status"))))
    assert files(store.path) == before


def test_only_touched_parts_are_read(spark, store):
    plans = []

    def look(old):
        plans.append(old._jdf.queryExecution().executedPlan().toString())
        return old

    store.rewrite(spark.createDataFrame([(5,)], "id long"), look)
    assert "PartitionFilters: [" in plans[0] and PART in plans[0].split("PartitionFilters: [")[1].split("]")[0]
