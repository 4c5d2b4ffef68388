"""Every query against its SQL twin, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from compare import connect, differences

from lumenframe import catalog


@pytest.fixture(scope="module")
def con(sf: str) -> duckdb.DuckDBPyConnection:
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        assert differences(df, con, catalog.ORACLE[name]) == ""
    else:
        assert df.count() >= 0


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLE) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
