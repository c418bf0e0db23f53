"""Every registered query against its oracle."""

import pytest

import __spark_entry__ as entry
from ixlake import plans as library
from oracle import compare

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_every_library_query_has_an_oracle():
    assert set(library.QUERIES) <= set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
