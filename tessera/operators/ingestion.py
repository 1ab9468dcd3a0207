"""Ingestion bookkeeping: admission, batches, sync, figures, captions, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ordering import ranked

MAX_BYTES = 50 * 1024 * 1024


def admit(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Uploads (name, size) with their verdict: accepted, empty or too_large."""
    return files.withColumn("verdict", F.when(F.col("size") <= 0, "empty").when(F.col("size") > most, "too_large").otherwise("accepted"))


#: Files of one upload.
MOST_FILES = 50


def admit_batches(files: DataFrame, most_files: int = MOST_FILES, most: int = MAX_BYTES) -> DataFrame:
    """``admit`` for uploads of several files (batch_id, name, size): every file of one with more than ``most_files`` is too_many."""
    n = files.groupBy("batch_id").agg(F.count("*").alias("n_files"))
    rows = admit(files, most).join(n, "batch_id")
    return rows.withColumn("verdict", F.when(F.col("n_files") > most_files, "too_many").otherwise(F.col("verdict"))).drop("n_files")


def batch_summary(items: DataFrame, statuses: tuple[str, ...] = ("queued", "processing", "success", "error")) -> DataFrame:
    """Per batch: a count for every status, zero included, sorted distinct types, and whether any item failed."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return items.groupBy("batch_id").agg(*counts, F.array_sort(F.collect_set("type")).alias("types"), F.bool_or(F.col("status") == "error").alias("any_error"))


def lifecycle(items: DataFrame) -> DataFrame:
    """Status of each item from its times and error: queued, processing, success or error."""
    return items.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("finished_at").isNotNull(), "success").when(F.col("started_at").isNotNull(), "processing").otherwise("queued"))


def unsynced(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Remote items whose key isn't there yet."""
    return remote.join(local.select(key).distinct(), key, "left_anti")


def sync_stats(changes: DataFrame) -> DataFrame:
    """Created, updated and failed items in all."""
    return changes.agg(*(F.count_if(F.col("change") == c).alias(n) for c, n in (("insert", "created"), ("update", "updated"), ("error", "errors"))))


def per_collection(items: DataFrame) -> DataFrame:
    """Items of each collection key; an item may name several (array ``collections``)."""
    return items.select(F.explode("collections").alias("collection")).groupBy("collection").agg(F.count("*").alias("n_items"))


def parent_of_figures(figures: DataFrame, docs: DataFrame) -> DataFrame:
    """The document of each figure (figure_id, parent_id, collection, title): by id, else the first of its collection with the same normal title."""
    by_id = docs.select(F.col("doc_id").alias("parent_id"), F.col("doc_id").alias("hit"))
    by_title = docs.groupBy("collection", T.title_key(F.col("title")).alias("key")).agg(F.min("doc_id").alias("guess"))
    rows = figures.withColumn("key", T.title_key(F.col("title"))).join(by_id, "parent_id", "left").join(by_title, ["collection", "key"], "left")
    return rows.select("figure_id", F.coalesce("hit", "guess").alias("doc_id"))


def type_overrides(docs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Documents with the type their last parser output (ord) gave; their own without one."""
    last = outputs.groupBy("doc_id").agg(F.max_by("type", "ord").alias("override"))
    return docs.join(last, "doc_id", "left").withColumn("type", F.coalesce("override", "type")).drop("override")


def figure_caption(title: Column, found: Column, number: Column, kind: Column) -> Column:
    """The found caption, else ``Figure n from title (kind)``."""
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), F.concat(F.lit("Figure "), number.cast("string"), F.lit(" from "), title, F.lit(" ("), kind, F.lit(")")))


#: How a caption begins, in the order they are tried: kind, number, text of ten characters at least.
CAPTIONS = (r"(?i)(Figure|Fig\.?)\s*(\d+[a-z]?)\s*[:.\-–—]\s*(.{10,})", r"(?i)(Scheme|Chart|Diagram|Plot)\s*(\d+[a-z]?)\s*[:.\-–—]\s*(.{10,})")


def captions_in(blocks: DataFrame) -> DataFrame:
    """Text blocks (page, block, text and other columns) that hold a caption, with its label and text."""
    part = lambda k: F.coalesce(*(F.nullif(F.regexp_extract("text", p, k), F.lit("")) for p in CAPTIONS))
    label = F.concat(part(1), F.lit(" "), part(2))
    rows = blocks.where(F.col("text").rlike(CAPTIONS[0]) | F.col("text").rlike(CAPTIONS[1]))
    return rows.withColumn("label", label).withColumn("caption", F.regexp_replace(F.concat("label", F.lit(": "), part(3)), "^[: ]+|[: ]+$", ""))


def error_report(context: Column, kind: Column, message: Column) -> Column:
    """``[context] Kind: message``, the message cut to 200 characters."""
    return F.concat(F.lit("["), context, F.lit("] "), kind, F.lit(": "), F.substring(message, 1, 200))


def anchored(children: DataFrame) -> DataFrame:
    """Rows (id, parent_id, title) in display order: roots by title, each followed by its children by title. Ranked over ranges of that order."""
    parent = children.select(F.col("id").alias("pid"), F.lower("title").alias("ptitle"))
    rows = children.join(parent, F.col("parent_id") == F.col("pid"), "left")
    rows = rows.select("id", F.coalesce("ptitle", F.lower("title")).alias("a"), F.coalesce("pid", "id").alias("b"), F.col("pid").isNotNull().alias("c"), F.lower("title").alias("d"))
    return ranked(rows, "a", "b", "c", "d", "id", name="position").select("id", F.col("position").cast("int").alias("position"))


def delay(stage_ms: Column) -> Column:
    """A stage's time rounded to a tenth of a millisecond."""
    return F.round(stage_ms, 1)
