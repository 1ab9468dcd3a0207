"""Names, functions and SQL of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query of (table reader) -> DataFrame; ``sql`` gives the same rows."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLES[name] = sql
        return f

    return add
