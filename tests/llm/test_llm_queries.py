"""Every query of the subpackage against its SQL on the smallest tables, and that each is registered."""

import pytest

from oracle import compare, connect
from tablewright.llm.registry import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    assert ok, message


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
