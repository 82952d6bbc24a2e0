"""Every operator's query against its SQL (small scale)."""

import pytest

from ledgerlark.llm.queries import ORACLES, QUERIES
from ledgerlark.plans.check import compare, duck_connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_sql(spark, con, name):
    res = compare(QUERIES[name](spark, SF), ORACLES[name], con)
    assert res["match"], res
