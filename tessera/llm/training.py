"""Bounded training samples and hash folds shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textlib import crc32_rem


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, hold: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: doc_id, text, label.

    The rows of least hash of their id are taken, so the sample does not depend on
    order or partitioning. Only ids and labels are sorted; their number bounds what is
    broadcast to the scan of the texts. Where an id has several labels the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where(f"doc_id IS NOT NULL AND label IS NOT NULL AND {crc32_rem('doc_id', folds)} <> {hold}")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label")).limit(rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])


def held_out(folds: int, hold: int):
    """Whether a row's fold is the held-out one; false without an id."""
    return F.coalesce(F.expr(f"{crc32_rem('doc_id', folds)} = {hold}"), F.lit(False))
