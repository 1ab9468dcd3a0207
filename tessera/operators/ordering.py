"""Global order of a table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import written


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order, which should be total.

    The sort deals ranges of the order to tasks and is written once, each row with its range
    and place in it. What comes before a range is a sum over one count a range, which is all that meets in one task. A hot value
    that fills a range is told apart by the later keys of the order.
    """
    placed = F.monotonically_increasing_id()
    parts = written(rows.orderBy(*order).withColumn("_at", placed), "ordered")
    at = parts.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = at.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = at.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    return joined.withColumn(name, (F.col("_before") + F.col("_row") + 1).cast("long")).drop("_at", "_part", "_row", "_before")


def page(rows: DataFrame, *order: Column | str, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the order, with ``rank``: cut by rank, so a deep page costs what the first does."""
    return ranked(rows, *order).where(F.col("rank").between((number - 1) * size + 1, number * size))
