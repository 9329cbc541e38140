"""Every registered query with SQL gives the same rows as the SQL."""

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    note, rows = check.compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert not note or note.startswith("types"), note
    assert rows >= 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
