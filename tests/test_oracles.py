"""Every query with oracle SQL gives the oracle's rows at the smallest scale."""

import pytest

from __spark_entry__ import entry
from lamella.plans.registry import ORACLES, QUERIES
from tests.compare import diff, duck, rows_of_duck, rows_of_spark

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLES
    got = rows_of_spark(QUERIES[name](spark, FOLDER))
    assert got[1], "no rows"
    assert diff(got, rows_of_duck(con, ORACLES[name])) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r for r in rows if r.is_overall]
