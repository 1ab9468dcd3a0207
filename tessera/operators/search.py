"""Hybrid retrieval: vector, trigram and exact-term legs, their union, reranking and packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tessera.functions import text as T
from tessera.functions.vectors import l2_distance
from tessera.shared import spread, written

#: Short and long queries by length, the scale of each, the multiplier and caps (fixed values).
SHORT, LONG, SCALES, MULTIPLIER, CAP = 48, 160, (0.9, 1.0, 1.1), 3.0, 12


def limits(query: str, top_k: int) -> int:
    """Candidates a leg gives for ``top_k`` results."""
    n = len(query.strip())
    scale = SCALES[0] if n <= SHORT else SCALES[2] if n >= LONG else SCALES[1]
    return max(top_k + 2, min(CAP, int(top_k * MULTIPLIER * scale)))


def exact_terms(spark: SparkSession, query: str, most: int = 8) -> list[str]:
    """``text.exact_terms`` of one query, worked out once for the plan."""
    return spark.range(1).select(T.exact_terms(F.lit(query), most)).first()[0]


def vector_top(vectors: DataFrame, query: Sequence[float], n: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``n`` nearest by L2 distance, ties by id, with rank."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, l2_distance(F.col(vec_col), F.array(*map(F.lit, map(float, query)))).alias("distance"))
    return rows.orderBy("distance", id_col).limit(n)


def plain_words(text: Column) -> Column:
    """Lower-case words with single spaces between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def trigram_codes(plain: str) -> np.ndarray:
    """Distinct trigrams of words that single spaces part, each padded by two spaces before and one after, as sorted numbers of 63 bits."""
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = c != 32
    at, first = np.flatnonzero(word), np.flatnonzero(word[1:] & ~word[:-1]) + 1
    pack = lambda x, y, z: x << np.uint64(42) | y << np.uint64(21) | z
    return np.unique(np.concatenate([pack(c[at - 1], c[at], c[at + 1]), pack(np.uint64(32), np.uint64(32), c[first])]))


def trigram_scores(chunks: DataFrame, query: str, content: bool = True) -> DataFrame:
    """``chunks``, with or without their content, with ``similarity``: the share of the trigrams of a chunk and the query that are in both.

    As ``text.similarity`` of ``text.trigrams``, which make an object for every trigram; here
    a chunk's are numbers in one array.
    """
    known = trigram_codes(chunks.sparkSession.range(1).select(plain_words(F.lit(query))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, x in enumerate(b.column(b.num_columns - 1)):
                mine = trigram_codes(x.as_py() or "")
                both = np.isin(mine, known, assume_unique=True).sum()
                out[i] = both / max(1, len(mine) + len(known) - both)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "similarity"])

    kept = chunks if content else chunks.drop("content")
    schema = T_.StructType([*kept.schema.fields, T_.StructField("similarity", T_.DoubleType())])
    return chunks.select(*kept.columns, plain_words(F.col("content")).alias("_plain")).mapInArrow(run, schema)


#: A similarity that counts is above this (fixed value).
LEAST = 1e-6


def trigram_top(chunks: DataFrame, query: str, n: int, least: float = LEAST) -> DataFrame:
    """The ``n`` chunks most similar to the query by trigrams, ties by doc_id and chunk_number."""
    rows = trigram_scores(spread(chunks.select("doc_id", "chunk_number", "content")), query).where(F.col("similarity") > least)
    return rows.orderBy(F.desc("similarity"), "doc_id", "chunk_number").limit(n)


def term_match(content: Column, terms: Sequence[str]) -> Column:
    """Whether a text contains any of the terms, whatever the case."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(content), F.lower(t))) if terms else F.lit(False)


def exact_top(chunks: DataFrame, terms: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` chunks, by doc_id and chunk_number, that contain a term."""
    return chunks.where(term_match(F.col("content"), terms)).orderBy("doc_id", "chunk_number").limit(n)


def union_keep_first(legs: Sequence[DataFrame]) -> DataFrame:
    """Candidates of all legs (doc_id, chunk_number, place), each under its first leg and place; column ``rank`` from 1.

    Legs are top-k results, so the rows ranked here are bounded by the legs' limits.
    """
    rows = None
    for i, leg in enumerate(legs):
        part = leg.select("doc_id", "chunk_number", F.lit(i).alias("leg"), "place")
        rows = part if rows is None else rows.union(part)
    first = rows.groupBy("doc_id", "chunk_number").agg(F.min(F.struct("leg", "place")).alias("at"))
    return first.select("doc_id", "chunk_number", F.col("at.leg").alias("leg"), F.row_number().over(Window.orderBy("at")).alias("rank"))


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """Numbers the rows of a top-k result."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def rerank(candidates: DataFrame, top_k: int, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """By score descending, ties in candidate order; without a model the candidate order stands."""
    rows = candidates.withColumn("score", score(F.col("content")) if score else F.lit(0.0))
    rows = rows.orderBy(F.desc("score"), "rank").limit(top_k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank")))


def hybrid(chunks: DataFrame, query: str, top_k: int = 10, vectors: DataFrame | None = None, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """Vector leg (``vectors``: doc_id, chunk_number, distance), trigram leg and exact-term leg, united in this order, then reranked.

    One pass over the texts judges each chunk for both text legs and keeps no text; that of
    the few candidates is read at the end, from their documents alone.
    """
    n = limits(query, top_k)
    terms = exact_terms(chunks.sparkSession, query)
    judged = spread(chunks.select("doc_id", "chunk_number", "content")).withColumn("named", term_match(F.col("content"), terms))
    judged = written(trigram_scores(judged, query, content=False), "judged")
    legs = [] if vectors is None else [placed(vectors.orderBy("distance", "doc_id", "chunk_number").limit(n), "distance", "doc_id", "chunk_number")]
    legs.append(placed(judged.where(F.col("similarity") > LEAST).orderBy(F.desc("similarity"), "doc_id", "chunk_number").limit(n), F.desc("similarity"), "doc_id", "chunk_number"))
    legs.append(placed(judged.where("named").orderBy("doc_id", "chunk_number").limit(n), "doc_id", "chunk_number"))
    found = written(union_keep_first(legs), "candidates")
    few = [r["doc_id"] for r in found.select("doc_id").distinct().collect()]  # as many as the legs give at most
    texts = chunks.where(F.col("doc_id").isin(few)).select("doc_id", "chunk_number", "content")
    return rerank(texts.join(F.broadcast(found), ["doc_id", "chunk_number"]), top_k, score)


def pack(results: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Result rows as JSON: rank, ids, citation and text, with a title or ``Untitled Document``."""
    rows = results if titles is None else results.join(titles, "doc_id", "left")
    title = F.coalesce("title", F.lit("Untitled Document")) if titles is not None else F.lit("Untitled Document")
    rows = rows.withColumn("citation", T.citation(F.col("doc_id"), F.col("chunk_number"))).withColumn("title", title)
    return rows.select("rank", "doc_id", "chunk_number", "title", "citation", T.cut(F.col("content")).alias("text"))


def pack_results(results: DataFrame, searches: DataFrame, prefix: str, compact: bool = False) -> DataFrame:
    """What each search answers: search_id, result (JSON rows), status, message, n, titles (sorted, distinct), shows_images.

    ``results`` (search_id, rank, chunk_id, doc_id, chunk_number, title, content, modality, has_image), a top-k each; ``searches``
    (search_id, text, scope). A row of a document with an image that can be shown has its type and a link below
    ``prefix``. ``compact`` rows have short names. A search without rows says what was searched for.
    """
    short = {"rank": "r", "chunk_id": "i", "doc_id": "d", "chunk": "c", "title": "n", "citation": "ref", "type": "ty", "text": "x", "image_url": "u"}
    title = F.coalesce("title", F.lit("Untitled Document"))
    kind = F.when(F.col("has_image"), F.when(F.col("modality") == "image", "image").otherwise("text_with_image"))
    link = F.when(F.col("has_image"), F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit("/")))
    fields = {"rank": F.col("rank"), "chunk_id": F.col("chunk_id"), "doc_id": F.col("doc_id").cast("string"), "chunk": F.col("chunk_number"), "title": title, "citation": T.citation(F.col("doc_id"), F.col("chunk_id")), "type": kind, "text": T.cut(F.col("content")), "image_url": link}
    rows = results.select("search_id", "rank", title.alias("title"), F.coalesce("has_image", F.lit(False)).alias("shown"), F.struct(*(c.alias(short[k] if compact else k) for k, c in fields.items())).alias("row"))
    some = rows.groupBy("search_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda x: x["row"])).alias("result"), F.count("*").alias("n"), F.array_sort(F.collect_set("title")).alias("titles"), F.bool_or("shown").alias("shows_images"))
    scope, text = T.squeeze(F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit("documents"))), T.squeeze(F.coalesce("text", F.lit("")))
    asked = F.when(text == "", "").otherwise(F.concat(F.lit(' for "'), text, F.lit('"')))
    told = F.concat(F.lit("I searched "), scope, asked, F.lit(", but retrieval returned no relevant passages."))
    found = F.col("n").isNotNull()
    return searches.join(some, "search_id", "left").select(
        "search_id", F.coalesce("result", F.lit("[]")).alias("result"), F.when(found, "results_found").otherwise("no_results").alias("status"), F.when(~found, told).alias("message"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), F.coalesce("shows_images", F.lit(False)).alias("shows_images"),
    )


def around(chunks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """For each wanted (doc_id, chunk_number) the chunks up to ``k`` before and after, joined by line breaks."""
    if not 1 <= k <= 10:
        raise ValueError("k must be from 1 to 10")
    w = wanted.select("doc_id", F.col("chunk_number").alias("center"))
    rows = chunks.select("doc_id", "chunk_number", "content").join(w, "doc_id").where(F.col("chunk_number").between(F.col("center") - k, F.col("center") + k))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_number", "content")))
    return rows.groupBy("doc_id", "center").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"), F.count("*").alias("n_chunks"))


def highlight(text: Column, start: Column, end: Column, threshold: int = 500_000, padding: int = 5_000) -> Column:
    """The part of a text that is shown around a chunk: text_offset and window. Only texts longer than ``threshold`` are cut, to ``padding`` characters on both sides."""
    n = F.length(text)
    low = F.when(n > threshold, F.greatest(F.lit(0), start - padding)).otherwise(0).cast("int")
    high = F.when(n > threshold, F.least(n, end + padding)).otherwise(n).cast("int")
    return F.struct(low.cast("long").alias("text_offset"), F.substring(text, low + 1, high - low).alias("window"))


def by_given_order(df: DataFrame, ids: Sequence[int], id_col: str) -> DataFrame:
    """The rows with the given ids, ``pos`` being their place in the list."""
    places = df.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], f"{id_col} long, pos int")  # as large as the caller's list
    return df.join(F.broadcast(places) if len(ids) <= 100_000 else places, id_col).orderBy("pos")
