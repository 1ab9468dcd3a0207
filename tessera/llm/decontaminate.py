"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is the set of its distinct word shingles. Items are partitioned by the size
of that set (powers of two). Of each item its ``s`` least hashes are its MinHash
sketch, ``s`` being the partition's largest ``n - ceil(threshold * n) + 1``: a document
that contains the threshold's share of an item misses fewer shingles than the sketch
has, so it must hold one of them. The search therefore loses nothing, however
long the document; banding whole documents of thousands of shingles against an item
of thirty would work at Jaccard similarities of a hundredth. Pairs found by a
sketch are verified by counting the item's distinct shingles in the document, compared
as words.

All of it is DataFrame operations. Documents' shingles are hashed and reduced within
the row; only those of a sketch leave the scan. A side of at most ``broadcast_rows`` rows is
broadcast, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, width: int) -> Column:
    """Distinct hashes of the runs of ``width`` words."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) >= width, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def runs(words: Column, width: int) -> Column:
    """Distinct runs of ``width`` words, joined by spaces."""
    found = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))
    return F.when(F.size(words) >= width, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def item_index(items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Distinct shingles of the items: item_id, width, run, h, n_item, in_sketch."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    size = F.least(F.size("words"), F.lit(width))
    items = written(items.select("item_id", size.alias("width"), F.coalesce(*(F.when(size == k, runs(F.col("words"), k)) for k in range(1, width + 1))).alias("runs")), "items")
    part = F.split("run", " ")
    h = F.coalesce(*(F.when(F.col("width") == k, F.xxhash64(*(F.get(part, F.lit(i)) for i in range(k)))) for k in range(1, width + 1)))
    index = items.select("item_id", "width", F.explode("runs").alias("run")).distinct().withColumn("h", h)
    sizes = index.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # A partition's sketch is as long as its largest item needs.
    sizes = sizes.withColumn("part", F.floor(F.log2("n_item"))).withColumn("s", F.expr(f"n_item - ceil({percent} * n_item / 100) + 1"))
    longest = sizes.groupBy("part").agg(F.max("s").alias("sketch"))
    sizes = sizes.join(longest, "part").select("item_id", "n_item", "sketch")
    order = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "run"))
    return written(index.join(sizes, "item_id").withColumn("at", order).select("item_id", "width", "run", "h", "n_item", (F.col("at") <= F.col("sketch")).alias("in_sketch")), "index")


def _small(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def candidates(docs: DataFrame, index: DataFrame, widths: list[int], broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs doc_id, item_id of a document (doc_id, words) and an item one of whose sketch's hashes it holds."""
    found, side = None, _small(index.where("in_sketch").select("item_id", "width", "h"), broadcast_rows)
    for k in widths:
        rows = docs.select("doc_id", F.explode_outer(shingles(F.col("words"), k)).alias("h"))
        rows = rows.join(side.where(F.col("width") == k), "h").select("doc_id", "item_id")
        found = rows if found is None else found.union(rows)
    return found.distinct()


def verify(docs: DataFrame, pairs: DataFrame, index: DataFrame, widths: list[int], broadcast_rows: int = 1_000_000) -> DataFrame:
    """For each pair the item's distinct shingles that the document holds, compared as words: doc_id, item_id, n_item, n_found."""
    docs = docs.join(_small(pairs.select("doc_id").distinct(), broadcast_rows), "doc_id", "left_semi")
    held, side = None, _small(index.select("item_id", "width", "run", "n_item"), broadcast_rows)
    for k in widths:
        rows = docs.select("doc_id", F.explode_outer(runs(F.col("words"), k)).alias("run"))
        rows = rows.join(side.where(F.col("width") == k), "run").select("doc_id", "item_id", "n_item", "run")
        held = rows if held is None else held.union(rows)
    return held.join(_small(pairs, broadcast_rows), ["doc_id", "item_id"]).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.count_distinct("run").alias("n_found"))


def search(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs of a document and an item it contains.

    ``docs`` (doc_id, text), ``items`` (item_id, text); other columns are ignored. An item
    of fewer than ``width`` words is one shingle, its whole sequence; one without words
    is contained in nothing. Returns doc_id, item_id, n_item (its shingles), n_found (those
    in the document), containment, for pairs with 100 * n_found >= ``percent`` * n_item.
    Rows that share an id count as one; rows without an id, null and empty texts give no
    pairs, nor do empty tables.
    """
    index = item_index(items, width, percent)
    widths = sorted(r[0] for r in index.select("width").distinct().collect())  # at most ``width`` rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("words")).where("doc_id IS NOT NULL")
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_found long, containment double")
    pairs = written(candidates(docs, index, widths, broadcast_rows), "pairs")
    found = verify(docs, pairs, index, widths, broadcast_rows)
    found = found.where(f"100 * n_found >= {percent} * n_item")
    return found.select("doc_id", "item_id", "n_item", "n_found", F.round(F.col("n_found") / F.col("n_item"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item.

    Each row is judged by its own text: rows that share a doc_id, or have none, don't share a
    verdict; rows with one doc_id and one text do. Null and empty texts stay. An empty table,
    of documents or of items, changes nothing.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    found = search(docs.select(key.alias("doc_id"), "text"), items, **kw).select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(found, "_key", "left_anti").select(*docs.columns)
