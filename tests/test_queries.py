"""Registered queries against their SQL on another engine."""

import duckdb
import pytest

from tessera import plans

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str([getattr(x, "item", lambda x=x: x)() for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else v


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    for c in frame.columns:
        frame[c] = frame[c].map(plain)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def small():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


#: Queries that find nothing in the small tables by their nature.
NOTHING = {"vector_cosine_threshold"}


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, small, name):
    got, want = plans.QUERIES[name](spark, SMALL).toPandas(), small.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in NOTHING


def test_every_oracle_has_its_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
