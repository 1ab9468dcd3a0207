"""Queries of the numbered operators against their SQL on another engine."""

import duckdb
import pytest

from tessera.llm import queries
from tests.test_queries import SMALL, TABLES, rows


@pytest.fixture(scope="module")
def small():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, small, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), small.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_every_numbered_operator_has_its_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
