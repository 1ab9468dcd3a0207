"""Sinks and connectors: CSV export, upserts, injected HTTP readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, gzip: bool = False, one_file: bool = False) -> None:
    """CSV with a header and minimal quoting; ``one_file`` gathers an export that must be one ordered file."""
    df = df.coalesce(1) if one_file else df
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def changes(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What each key of two tables of the same columns needs: the columns (those of ``incoming`` where it has the key) and ``change``: insert, update, delete or keep. Keys are unique in both."""
    rest = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*rest).alias("_old"), F.lit(True).alias("_had"))
    new = incoming.select(*keys, F.struct(*rest).alias("_new"), F.lit(True).alias("_has"))
    same = F.to_json("_old", {"ignoreNullFields": "false"}).eqNullSafe(F.to_json("_new", {"ignoreNullFields": "false"}))
    change = F.when(F.col("_had").isNull(), "insert").when(F.col("_has").isNull(), "delete").when(same, "keep").otherwise("update")
    value = F.when(F.col("_has").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return new.join(old, keys, "full").select(*keys, *(value[c].alias(c) for c in rest), change.alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str, delete_missing: bool = True) -> DataFrame:
    """The table after a batch: incoming rows enter or replace those of equal keys, of several the last by ``order``; keys that the batch lacks go, or stay if ``delete_missing`` is false."""
    rest = [c for c in current.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))
    rows = changes(current, last, keys)
    return (rows.where("change <> 'delete'") if delete_missing else rows).select(*current.columns)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON column of the given columns."""
    return df.select(F.to_json(F.struct(*columns)).alias("payload"))


def fetch(spark: SparkSession, ids: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """Rows (id, content, error) of an external service; ``get`` is the injected client, called once for each id of column ``id``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                try:
                    out.append((i, get(i), None))
                except Exception as e:  # noqa: BLE001  a failed call is a row with its error
                    out.append((i, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["id", "content", "error"])

    return ids.select("id").mapInPandas(run, "id string, content binary, error string")


def pages_of(get: Callable[[int], tuple[list[dict], bool]]) -> Iterator[dict]:
    """Items of a paginated service; ``get(start)`` gives a page and whether more follow."""
    start, more = 0, True
    while more:
        items, more = get(start)
        yield from items
        start += len(items)
        more = more and bool(items)
