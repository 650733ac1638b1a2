"""Every registered query gives what its oracle SQL gives."""

import pytest

import __spark_entry__ as entry
from gleaner.catalog import load
from tools.check_oracle import compare, connect

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    assert compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES.get(name)) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_holds_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
