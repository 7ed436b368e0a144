"""Every registered query with an oracle against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare
from zonecast.catalog import oracles

ORACLE = oracle_sql()
#: Queries of the training-data package have their tests in a folder of their own.
LLM = set(ORACLE) - set(oracles.build())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(queries())


@pytest.mark.parametrize("name", [n for n in ORACLE if n not in LLM])
def test_query(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(ORACLE[name]).df()) == "ok"


def test_entry(spark):
    assert entry(spark).count() > 0
