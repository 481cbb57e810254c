"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, TWINS[name]) == ""


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry_has_one_score(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0.0 < rows[0]["score"] < 1.0
