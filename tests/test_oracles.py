"""Every registered query against its DuckDB oracle (small scale; the driver
runs the same comparison at sf0.01)."""

import pytest

from helpers_business import SF_SMALL
from ledgerlark.plans.check import compare, duck_connect
from ledgerlark.plans.registry import all_queries


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n, s in all_queries().items() if s.oracle))
def test_matches_oracle(spark, con, name):
    spec = all_queries()[name]
    res = compare(spec.build(spark, SF_SMALL), spec.oracle, con)
    assert res["match"], res


def test_every_query_has_an_oracle():
    assert all(s.oracle for s in all_queries().values())
