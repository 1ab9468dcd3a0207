"""Where a passage stands in the text items of a document's pages: by its beginning and its end, tolerant of how the pages were read."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shared import written

#: Least and most characters of an anchor; quotes, dashes and the soft hyphen with what they count as.
LEAST, MOST = 20, 150
LOOKALIKES = {"­": None, **dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("‐‑‒–—―", "-")}
_SAME = str.maketrans(LOOKALIKES)


def normal(text: str) -> str:
    """Compatibility form with plain quotes and dashes, single spaces, trimmed, lower-cased."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).translate(_SAME)).strip().lower()


def normal_form(text: Column) -> Column:
    """``normal`` by row; Spark has no function for Unicode's compatibility form."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(normal)

    return form(text)


def start_anchor(passage: Column) -> Column:
    """The first 150 characters of a passage, up to the last space if that lies in their second half."""
    whole = F.trim(passage)
    cut = F.substring(whole, 1, MOST)
    at = MOST - F.locate(" ", F.reverse(cut))
    return F.when(F.length(whole) <= MOST, whole).when((at < MOST) & (at > MOST // 2), F.substring(cut, F.lit(1), at)).otherwise(cut)


def end_anchor(passage: Column) -> Column:
    """The last 150 characters of a passage, from the first space on if that lies in their first half."""
    whole = F.trim(passage)
    cut = F.right(whole, F.lit(MOST))
    at = F.locate(" ", cut) - 1
    return F.when(F.length(whole) <= MOST, whole).when((at >= 0) & (at < MOST // 2), F.substring(cut, at + 2, F.lit(MOST))).otherwise(cut)


#: A page's items as running text: without anything between them, with spaces, and as their letters and digits alone.
FORMS = ("tight", "spaced", "bare")


def bare(text: Column) -> Column:
    """Letters and digits of a text in normal form."""
    return F.regexp_replace(text, "[^a-z0-9]+", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of one page that follow each other as one row: their numbers, and their texts in normal form, which has no line break, line by line."""
    for b in batches:
        ids, pages = b.column("doc_id").to_pylist(), b.column("page").to_pylist()
        first = [i for i in range(b.num_rows) if not i or ids[i] != ids[i - 1] or pages[i] != pages[i - 1]]
        texts = [normal(x or "") for x in b.column("text").to_pylist()]
        ends = [*first[1:], b.num_rows][: len(first)]
        at = pa.array(first, pa.int64())
        items = pa.ListArray.from_arrays(pa.array([*first, b.num_rows], pa.int32()), b.column("item"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("page").take(at), items, pa.array(["\n".join(texts[i:j]) for i, j in zip(first, ends)], pa.string())], ["doc_id", "page", "items", "texts"])


def page_texts(items: DataFrame) -> DataFrame:
    """Pages of ``items`` (doc_id, page, item, text): doc_id, page, n, and for each form its text and where each item begins in it."""
    runs = items.select("doc_id", "page", "item", F.col("text").cast("string").alias("text"))
    kinds = runs.schema
    runs = runs.mapInArrow(_runs, T.StructType([kinds["doc_id"], kinds["page"], T.StructField("items", T.ArrayType(kinds["item"].dataType)), T.StructField("texts", T.StringType())]))
    # By document alone: passages then meet its pages where they lie.
    runs = runs.repartition("doc_id").groupBy("doc_id", "page").agg(F.collect_list(F.struct("items", "texts")).alias("runs"))
    each = F.transform("runs", lambda r: F.zip_with(r["items"], F.split(r["texts"], "\n", -1), lambda i, t: F.struct(i.alias("item"), t.alias("text"))))
    rows = runs.select("doc_id", "page", F.transform(F.array_sort(F.flatten(each)), lambda x: x["text"]).alias("parts")).withColumn("letters", F.transform("parts", bare))

    def begins(parts: str, gap: int) -> Column:
        return F.slice(F.aggregate(F.transform(parts, F.length), F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n + gap))), 1, F.size(parts))

    forms = (("tight", "parts", ""), ("spaced", "parts", " "), ("bare", "letters", ""))
    return rows.select("doc_id", "page", F.size("parts").alias("n"), *(F.array_join(p, gap).alias(name) for name, p, gap in forms), *(begins(p, len(gap)).alias(f"{name}_at") for name, p, gap in forms))


def find(anchor: Column, after: Column) -> Column:
    """First and last item (``first``, ``last``) of an anchor's first hit on a page at or after an item, in the first form that has one; null without."""

    def hit(form: str) -> Column:
        at = F.col(f"{form}_at")
        needle = bare(anchor) if form == "bare" else anchor
        begin = F.when((after > 0) & (after < F.col("n")), F.get(at, after)).otherwise(0)
        place = F.call_function("locate", needle, F.col(form), begin + 1) - 1
        item = lambda p: F.size(F.filter(at, lambda s: s <= p)) - 1
        fits = (F.length(anchor) >= LEAST) & (F.length(needle) >= LEAST) & (place >= 0)
        return F.when(fits, F.struct(item(place).alias("first"), item(place + F.length(needle) - 1).alias("last")))

    return F.coalesce(*map(hit, FORMS))


def locate(items: DataFrame, passages: DataFrame) -> DataFrame:
    """Items to highlight for each passage: passage_id, page, first_item, last_item; none where it isn't found.

    ``items`` (doc_id, page, item, text), ``passages`` (passage_id, doc_id, text). Of a passage
    of up to 150 characters the whole must stand on one page; a longer one reaches from
    its beginning to its end, over pages in between; if the end isn't found, to the end of
    the first page. Passages meet the pages of their document one by one; no document is read as a whole.
    """
    rows = passages.where(F.length(F.trim("text")) >= LEAST).select("passage_id", "doc_id", start_anchor(F.col("text")).alias("start"), end_anchor(F.col("text")).alias("end"), (F.length(F.trim("text")) <= MOST).alias("short"))
    rows = rows.withColumns({c: normal_form(F.col(c)) for c in ("start", "end")})
    # The pages' texts meet the passages once; of a page stay where the beginning stands, and the end behind it (``same``) and anywhere (``stop``).
    met = rows.join(page_texts(items), "doc_id").withColumn("hit", find(F.col("start"), F.lit(0)))
    same, stop = F.when(F.col("hit").isNotNull() & ~F.col("short"), find(F.col("end"), F.col("hit.last")))["last"], F.when(~F.col("short"), find(F.col("end"), F.lit(0)))["last"]
    met = written(met.select("passage_id", "doc_id", "short", "page", "n", "hit", same.alias("same"), stop.alias("stop")), "met")
    begun = met.where("hit IS NOT NULL").groupBy("passage_id", "doc_id", "short").agg(F.min(F.struct("page", "hit", "n", "same")).alias("at"))
    begun = begun.select("passage_id", "doc_id", "short", F.col("at.page").alias("k"), "at.hit", F.col("at.n").alias("size"), F.col("at.same").alias("same"))
    later = begun.where("NOT short AND same IS NULL").select("passage_id", "doc_id", "k").join(met.where("stop IS NOT NULL"), ["passage_id", "doc_id"]).where("page > k")
    later = later.groupBy("passage_id", "doc_id").agg(F.min(F.struct("page", F.col("stop").alias("last"))).alias("later"))
    to = F.when(F.col("same").isNotNull(), F.struct(F.col("k").alias("page"), F.col("same").alias("last"))).otherwise(F.col("later"))
    known = written(begun.join(later, ["passage_id", "doc_id"], "left").withColumn("to", to).drop("later", "same"), "known")
    # A passage within its first page, found whole or to that page's end.
    last = F.when(F.col("short"), F.col("hit.last")).when(F.col("to.page") == F.col("k"), F.greatest("hit.last", "to.last")).otherwise(F.col("size") - 1)
    first = known.select("passage_id", F.col("k").alias("page"), F.col("hit.first").alias("first_item"), last.alias("last_item"))
    more = known.where("to.page > k").join(met.select("passage_id", "doc_id", "page", "n").distinct(), ["passage_id", "doc_id"]).where("page > k AND page <= to.page")
    more = more.select("passage_id", "page", F.lit(0).alias("first_item"), F.when(F.col("page") == F.col("to.page"), F.col("to.last")).otherwise(F.col("n") - 1).alias("last_item"))
    return first.unionByName(more).select("passage_id", F.col("page").cast("int").alias("page"), F.col("first_item").cast("int").alias("first_item"), F.col("last_item").cast("int").alias("last_item"))
