"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from tidemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])) is None


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).count() > 0
