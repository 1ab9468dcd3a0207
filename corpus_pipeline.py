"""Corpus pipeline: from raw documents to token ids, in stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's documents. All
stages but the last return the columns of ``documents``. Columns that ``documents``
has besides these are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, near_dup, sentencepiece_codec, substring
from tessera.llm.common import written
from tessera.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones (without a letter, or below the calibrated confidence) go.

    Each row is judged by its own text, whatever its doc_id: null and empty texts go; rows
    without doc_id, repeated rows and rows that share a doc_id stay or go by their text. An
    empty table stays empty; where no document has a language, all go.
    """
    ship(spark)
    return language.identify(docs.select(*COLUMNS), keep=COLUMNS[1:]).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id: shingles of five words, similarity 0.8.

    Rows that share a doc_id are one document, and go or stay together. Rows without
    doc_id take no part and stay, as do null and empty texts. Of rows with one doc_id and one
    text (nulls being equal) one stays. An empty table stays empty.
    """
    ship(spark)
    return near_dup.keep_one(docs.select(*COLUMNS), once=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that start earlier in the corpus go; a changed text is its kept words joined by one space, any other stays as it is.

    All rows stay. Rows that share a doc_id lose what smaller ids have, each by its own
    words, and nothing to each other; rows without doc_id lose only their own repeats. Null
    stays null, n_chars counts what is left. An empty table stays empty.
    """
    ship(spark)
    rows = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    kept = substring.dedup(rows).where("kept_text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept_text").dropDuplicates(["id", "key"])
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    text = F.coalesce("kept_text", "text")
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: 0.8 of its shingles of five words.

    Each row is judged by its own text, with or without doc_id; repeated rows share a
    verdict. Null and empty texts stay. An empty table, of documents or of items, changes
    nothing.
    """
    ship(spark)
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, lang, source, n_tokens, ids.

    A row for each row. Null and empty texts have no tokens. An empty table gives an empty
    result.
    """
    ship(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load(), keep=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The first stage is a trained model, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
