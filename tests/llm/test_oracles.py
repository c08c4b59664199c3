"""Queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from heliograph.llm import registry
from tests.test_registry import TABLES, plain


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query(spark, sf, sql, key):
    assert plain(registry.queries()[key](spark, sf).toPandas()) == plain(sql.sql(registry.oracle_sql()[key]).df())
