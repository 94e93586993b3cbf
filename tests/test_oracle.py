"""Every registered query against its DuckDB oracle SQL on sf0.001."""

import pytest

import __spark_entry__ as entry
from keyfold.plans.catalog import QUERIES
from verify import compare, duck
from conftest import SF0001

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(entry.queries()[key](spark, SF0001), con, entry.oracle_sql()[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "event" in df.columns
