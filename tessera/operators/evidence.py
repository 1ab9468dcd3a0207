"""Evidence for answers: caps, budgets, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def _capped(results: DataFrame, cap: int, group: str) -> DataFrame:
    by_doc = Window.partitionBy(group, "doc_id")
    return results.withColumn("nth", F.row_number().over(by_doc.orderBy("rank"))).withColumn("first_rank", F.min("rank").over(by_doc)).where(F.col("nth") <= cap)


def cap_and_interleave(results: DataFrame, cap: int = 3, group: str = "query_id") -> DataFrame:
    """At most ``cap`` results of a document, dealt round: first each document's best, then its second, and so on."""
    rows = _capped(results, cap, group)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("nth", "first_rank"))).drop("nth", "first_rank")


def fill(results: DataFrame, tokens: int = 3500, cap: int = 3, group: str = "query_id", parts: int = 64) -> DataFrame:
    """``budget(cap_and_interleave(results))`` for large groups: query_id, doc_id, chunk_number, position, used.

    ``rank`` may be any sortable column without ties. A group is first dealt into ``parts`` by document.
    What exceeds the budget among its part's rows exceeds it among all, so only rows that
    fit within their part meet in the group's one window.
    """
    rows = _capped(results.select(group, "doc_id", "chunk_number", "rank", T.token_estimate(F.col("content")).alias("cost")), cap, group)

    def fit(rows, *keys):
        w = Window.partitionBy(*keys).orderBy("nth", "first_rank")
        rows = rows.withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))
        return rows.where((F.col("used") <= tokens) | (F.col("position") == 1))

    own = fit(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))), group, "part")
    return fit(own, group).select(group, "doc_id", "chunk_number", "position", "used")


def budget(results: DataFrame, tokens: int = 3500, group: str = "query_id", order: str = "position") -> DataFrame:
    """The leading results whose estimated tokens fit; the first always. As every cost is at least 1, a running sum stops where the loop would."""
    w = Window.partitionBy(group).orderBy(order)
    rows = results.withColumn("used", F.sum(T.token_estimate(F.col("content"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    return rows.where((F.col("used") <= tokens) | (F.col("n") == 1)).drop("n")


def packet(results: DataFrame, group: str = "query_id") -> DataFrame:
    """One row a query: citation tokens in order, distinct documents, number of chunks."""
    rows = results.withColumn("citation", T.citation(F.col("doc_id"), F.col("chunk_number")))
    ordered = F.array_sort(F.collect_list(F.struct("position", "citation")))
    return rows.groupBy(group).agg(F.array_distinct(F.transform(ordered, lambda x: x["citation"])).alias("citation_tokens"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.count("*").alias("n_chunks"))


def invalid_citations(answer: Column, allowed: Column) -> Column:
    """Citations of an answer that aren't allowed, in order of first use."""
    return F.array_except(T.citations(answer), allowed)


def allowed_or_all(used: Column, allowed: Column) -> Column:
    """Used citations that are allowed; all allowed ones if none is."""
    both = F.array_intersect(used, allowed)
    return F.when(F.size(both) > 0, both).otherwise(allowed)


def lines(texts: DataFrame, key: str) -> DataFrame:
    """Lines of each text with whether they stand inside a code fence and whether they are bullets."""
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith(F.ltrim("line"), F.lit("```"))
    return rows.withColumn("fences", F.sum(fence.cast("int")).over(w)).select(key, "line_no", "line", ((F.col("fences") % 2 == 1) | fence).alias("in_code"), F.col("line").rlike(r"^[ \t]*([-*]|[0-9]+[.)]) ").alias("bullet"))


def summary(results: DataFrame, group: str = "query_id", most: int = 5) -> DataFrame:
    """Bulleted first sentences with their citations, distinct, at most ``most``."""
    rows = results.select(group, "position", F.concat(F.lit("- "), T.first_sentence(F.col("content"), 240), F.lit(" "), T.citation(F.col("doc_id"), F.col("chunk_number"))).alias("point"))
    first = rows.groupBy(group, "point").agg(F.min("position").alias("position"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("position"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "point")))
    return first.withColumn("n", n).where(F.col("n") <= most).groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["point"]), "\n").alias("summary"))
