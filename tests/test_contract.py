"""All registered queries on the given tables, next to their SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences

SMALL = contract.SMALL
QUERIES, SQL = contract.metric_queries(), contract.metric_sql()

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) == []


def test_entry_is_the_known_funnel(spark):
    got = [r.users for r in contract.entry(spark).collect()]
    assert got == [150, 42, 34, 22, 21]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data here")
def test_known_numbers(spark):
    folder = "/root/testdata/sf0.01"
    funnel = QUERIES["funnel_stages"](spark, folder).collect()
    assert [r.users for r in funnel] == [1496, 473, 313, 220, 198]
    assert tuple(QUERIES["retention_overall"](spark, folder).first()) == (11.41, 31.58, 77.74)
    assert tuple(QUERIES["renewal_overall"](spark, folder).first())[::3] == (1025, 3.43)
    assert QUERIES["payments_sanity"](spark, folder).first().total_revenue == 884026334.29
    assert QUERIES["cohort_retention"](spark, folder).count() == 1845
