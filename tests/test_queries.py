"""Every query against its SQL: as the tables are, and with hot keys cut in many splits."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from oracle import connect, differences

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def medium_duck(medium):
    return connect(medium)


@pytest.fixture(scope="module")
def skewed_duck(skewed):
    return connect(skewed)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, medium, medium_duck, name):
    assert differences(QUERIES[name](spark, medium), medium_duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql_with_hot_keys(spark, skewed, skewed_duck, tiny_splits, name):
    assert differences(QUERIES[name](spark, skewed), skewed_duck, SQL[name]) == []
    assert skewed_duck.sql(f"SELECT count(*) FROM ({SQL[name]})").fetchall()[0][0] > 0


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_a_distinct_column_set(spark, small):
    for name in sorted(QUERIES.keys() - contract.LLM.keys()):
        columns = QUERIES[name](spark, small).columns
        assert len(columns) == len(set(columns)), name
