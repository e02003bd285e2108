"""Every registered query against its oracle SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from vacantia.plans import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(load()))
def test_query_matches_oracle(spark, con, name):
    problem = compare(spark, con, load()[name], FOLDER)
    assert problem is None, problem
