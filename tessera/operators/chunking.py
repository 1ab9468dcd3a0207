"""Cutting documents into overlapping chunks, and duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 2048, 384


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``: doc_id, kept columns, chunk_number, start_position, end_position, content.

    Empty and null texts have no chunks. The last window may lie within the one before it.
    """
    pitch = size - overlap
    rows = docs.where("length(text) > 0").select("doc_id", *keep, "text", F.explode(F.expr(f"sequence(0, (length(text) - 1) div {pitch})")).alias("k"))
    start = F.col("k") * pitch
    end = F.least(start + size, F.length("text"))
    return rows.select("doc_id", *keep, F.col("k").cast("int").alias("chunk_number"), start.cast("int").alias("start_position"), end.cast("int").alias("end_position"), F.substring("text", start + 1, F.lit(size)).alias("content"))


def image_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A caption chunk (at most 800 characters, ``Image chunk`` if blank) after the text chunks of each row of ``docs`` (doc_id, caption)."""
    last = chunks.groupBy("doc_id").agg(F.max("end_position").alias("at"), F.max("chunk_number").alias("n"))
    text = F.substring(F.coalesce(F.nullif(F.trim("caption"), F.lit("")), F.lit("Image chunk")), 1, 800)
    at = F.coalesce("at", F.lit(0))
    return docs.join(last, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(-1)) + 1).alias("chunk_number"), at.alias("start_position"), (at + F.greatest(F.length(text), F.lit(1))).alias("end_position"), text.alias("content"))


def exact_duplicates(docs: DataFrame, within: str) -> DataFrame:
    """The hash of each text and whether it is the first (least doc_id) with it in its group ``within``."""
    rows = docs.select("doc_id", within, F.sha2("text", 256).alias("text_hash"))
    first = rows.groupBy(within, "text_hash").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, [within, "text_hash"]).select("doc_id", within, "text_hash", "first_id", (F.col("doc_id") == F.col("first_id")).alias("accepted"))


def reuse_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """As ``chunk``, cutting each distinct text once and handing its chunks to every document with it."""
    keyed = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_hash"))
    donors = keyed.groupBy("text_hash").agg(F.min_by("text", "doc_id").alias("text"))
    cut = chunk(donors.withColumnRenamed("text_hash", "doc_id"), size, overlap).withColumnRenamed("doc_id", "text_hash")
    return keyed.drop("text").join(cut, "text_hash").drop("text_hash")


def progress(events: DataFrame, key: str, order: str, done: str, total: str) -> DataFrame:
    """Whole per cent done of each event, only where it differs from the event before it."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("percent", F.floor(100 * F.col(done) / F.col(total)).cast("long"))
    return rows.withColumn("before", F.lag("percent").over(w)).where("before IS NULL OR before <> percent").drop("before")
