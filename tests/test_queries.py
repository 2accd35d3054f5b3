"""Every query with a checking SQL text against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from solea.plans import ORACLES, QUERIES
from tests.compare import DATA, connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert difference(spark, con, name) is None


def test_entry_ranks_all_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() == 48 and "rank" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
