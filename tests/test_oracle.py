"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, why, _ = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["truth", "predicted", "n"] and df.count() == 36
