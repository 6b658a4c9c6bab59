"""Every registered query against its DuckDB statement, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from heartwood import oracle
from heartwood.plans import queries as registry

QUERIES = registry.queries()
ORACLES = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_belongs_to_a_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, key):
    assert difference(QUERIES[key](spark, sf_dir), duck, ORACLES[key]) is None


def test_entry_is_one_row_per_customer(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 52
    assert df.count() == df.select("customer_id").distinct().count() > 0
