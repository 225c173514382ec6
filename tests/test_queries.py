"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(entry.QUERIES), dict(entry.ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    note, same = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert same, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["window", "x", "y"] and df.count() > 0
