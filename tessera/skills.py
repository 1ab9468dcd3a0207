"""Skill modules, document tools and an optional prompt compressor."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.models import Tools
from tessera.operators import documents, images, search


def load(paths: Iterable[str]) -> tuple[list[ModuleType], dict[str, str]]:
    """Modules by name, each once, and why others could not be loaded."""
    found, failed = [], {}
    for path in dict.fromkeys(p.strip() for p in paths if p.strip()):
        try:
            found.append(importlib.import_module(path))
        except Exception as e:  # noqa: BLE001  one bad skill does not keep the others out
            failed[path] = f"{type(e).__name__}: {e}"
    return found, failed


def collect_tools(modules: Iterable[ModuleType], tools: Tools | None = None) -> Tools:
    """What the modules' ``tools()`` give; of equal names the first stays."""
    tools = tools or Tools()
    for m in modules:
        for f in getattr(m, "tools", lambda: [])():
            if f.__name__ not in tools.functions:
                tools.add(f)
    return tools


def collect_prompts(modules: Iterable[ModuleType]) -> str:
    """Texts of the modules' ``system_prompt_extra()``, blank ones left out, with an empty line between."""
    texts = (getattr(m, "system_prompt_extra", lambda: "")() for m in modules)
    return "\n\n".join(t.strip() for t in texts if t and t.strip())


def document_tools(chunks: DataFrame, docs: DataFrame, vectors: Callable[[str], DataFrame] | None = None) -> Tools:
    """Tools over chunks (doc_id, chunk_number, content) and documents (doc_id, title, text) that a user may see: search, list, whole text, search in one, neighbours."""
    tools = Tools()
    titles = docs.select("doc_id", "title")

    def vector_search(spark, search_string: str, top_k: int = 10) -> DataFrame:
        """Passages of all documents."""
        if not search_string.strip():
            raise ValueError("search_string must not be empty")
        if not 1 <= top_k <= 15:
            raise ValueError(f"top_k must be between 1 and 15, got {top_k}")
        return search.pack(search.hybrid(chunks, search_string, top_k, vectors(search_string) if vectors else None), titles)

    def document_ids(spark) -> DataFrame:
        """Titles and ids; of equal titles the last id."""
        return titles.groupBy("title").agg(F.max("doc_id").alias("doc_id"))

    def whole_document(spark, doc_id: int) -> DataFrame:
        """A document's whole text."""
        return documents.whole(docs.where(F.col("doc_id") == doc_id))

    def search_single_document(spark, doc_id: int, search_string: str, top_k: int = 5) -> DataFrame:
        """Passages of one document."""
        return search.pack(documents.search_one(chunks, doc_id, search_string, top_k), titles)

    def more_context(spark, doc_id: int, chunk_number: int, adjacent_chunks: int = 1) -> DataFrame:
        """A passage with its neighbours."""
        wanted = chunks.where((F.col("doc_id") == doc_id) & (F.col("chunk_number") == chunk_number)).select("doc_id", "chunk_number")
        return search.around(chunks, wanted, adjacent_chunks)

    for f in (vector_search, document_ids, whole_document, search_single_document, more_context):
        tools.add(f)
    return tools


def image_tools(arrays: dict[str, DataFrame]) -> Tools:
    """Tools over named images as pixel relations (y, x, v): difference, quotient, clipped statistics, point sources. Images of other shapes are refused."""
    tools = Tools()

    def pair(a: str, b: str) -> tuple[DataFrame, DataFrame]:
        if not images.same_shape(arrays[a], arrays[b]).isEmpty():
            raise ValueError(f"{a} and {b} differ in shape")
        return arrays[a], arrays[b]

    def subtract(spark, image: str, sky: str) -> DataFrame:
        """One image less another."""
        return images.combine(*pair(image, sky), "subtract")

    def divide(spark, image: str, flat: str) -> DataFrame:
        """One image by another."""
        return images.combine(*pair(image, flat), "divide")

    def statistics(spark, image: str) -> DataFrame:
        """Mean, deviation and number of an image's values without outliers."""
        return images.clipped_stats(arrays[image].withColumn("image_id", F.lit(image)))

    def point_sources(spark, image: str, times: float = 5.0) -> DataFrame:
        """Pixels far above the rest."""
        rows = arrays[image].withColumn("image_id", F.lit(image))
        return images.bright(rows, images.clipped_stats(rows), times)

    for f in (subtract, divide, statistics, point_sources):
        tools.add(f)
    return tools


def compressed(text: Column, compress: Callable[[Column], Column] | None = None) -> Column:
    """A compressor's text where that is shorter and not empty, else the text; without a compressor, as by default, all texts stay."""
    if compress is None:
        return text
    short = compress(text)
    return F.when((short != "") & (F.length(short) < F.length(text)), short).otherwise(text)
