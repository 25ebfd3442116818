"""Every registered query against its SQL on the smallest tables; model queries are covered in test_models."""

import pytest

from oracle import compare, connect
from tablewright.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert ok, message


def test_queries_without_sql_are_known():
    without = {n for n in QUERIES if n not in ORACLES}
    assert without == set()
