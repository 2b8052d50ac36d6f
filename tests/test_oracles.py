"""Every query with an SQL twin, side by side on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, msg = compare(spark, con, name, entry.queries()[name], ORACLES[name], SF)
    assert ok, msg


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["davies_bouldin"] <= 1
