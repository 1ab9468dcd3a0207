"""Documents of several subtypes: one table of them, lookup, resolution of ids, whole texts, search in one, prompt skills, quotes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search

#: Most tokens of a whole document in a chat, characters of a title, what a medium without text says.
WHOLE_TOKENS, TITLE_CHARS, NO_TEXT = 150_000, 200, "No text could be extracted from this media. "
#: Names of skill documents and of collections that hold nothing else, most characters of a prompt, what stands between its parts.
SKILL_NAMES, SKILL_PACKS, SKILL_CHARS, BETWEEN = ("skill", "skills"), ("skills", "skill_pack"), 12_000, "\n\n---\n\n"
#: Parts into which a collection's documents are dealt.
PARTS = 64


def unified(subtypes: Mapping[str, DataFrame]) -> DataFrame:
    """The subtypes' tables as one with column ``doc_type``; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("doc_type", F.lit(name)) for name, df in subtypes.items()))


def by_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The document of each wanted id; of several subtypes that have it, the first in their order (``doc_order``)."""
    rows = documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_order"))).where("n = 1").drop("n")


def where_known(rows: DataFrame, column: str, value: str | None, known: Sequence[str]) -> DataFrame:
    """Rows with the value; all rows if it isn't one of the known ones."""
    return rows.where(F.col(column) == value) if value in known else rows


def named(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose name contains a text, whatever the case and outer spaces; all rows for a blank one."""
    wanted = part.strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(wanted))) if wanted else rows


def has_any(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each group with whether it has a row."""
    return groups.join(rows.select(key).distinct().withColumn("has", F.lit(True)), key, "left").withColumn("has", F.coalesce("has", F.lit(False)))


def summed(rows: DataFrame, *columns: str) -> DataFrame:
    """Totals and number of rows, 0 where there is nothing to sum."""
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns), F.count("*").alias("n"))


def media_ref(item: Column, index: Column, modality: Column, content: Column) -> Column:
    """Reference that tells media without text apart: item, place, modality and twelve digits of the content's SHA-256."""
    return F.concat(F.lit("[ref:"), item.cast("string"), F.lit(":"), index.cast("string"), F.lit(":"), modality, F.lit(":"), F.substring(F.sha2(F.coalesce(content, F.lit("").cast("binary")), 256), 1, 12), F.lit("]"))


def stored_text(text: Column, ref: Column) -> Column:
    """A document's text, or a note with its reference where none was found."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(F.concat(F.lit(NO_TEXT), ref))


def modality(media_kind: Column, has_image: Column, has_audio: Column) -> Column:
    """audio or video as the kind says, else image, transcript or text by the files there are."""
    kind = F.lower(F.trim(media_kind))
    return F.when(kind.isin("audio", "video"), kind).when(has_image, "image").when(has_audio, "transcript").otherwise("text")


def first_named(*names: Column) -> Column:
    """The first name that isn't blank, trimmed; empty without."""
    return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names), F.lit(""))


def chunk_of(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Citations of wanted chunks (chunk_id, doc_id) that do belong to the document."""
    return wanted.join(chunks.select("chunk_id", "doc_id"), ["chunk_id", "doc_id"]).select("chunk_id", "doc_id", T.citation(F.col("doc_id"), F.col("chunk_id")).alias("citation"))


def whole(documents: DataFrame, most: int = WHOLE_TOKENS) -> DataFrame:
    """Whole text of each document (doc_id, text), or why it isn't opened."""
    big = T.token_estimate(F.col("text")) > most
    return documents.select("doc_id", F.when(~big, F.col("text")).alias("text"), F.when(big, F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" is too large to open in this chat."))).alias("exception"))


def search_one(chunks: DataFrame, doc_id: int | str, query: str, top_k: int, **kw) -> DataFrame:
    """``search.hybrid`` within one document; refuses an empty query and a ``top_k`` outside 1 to 15."""
    if not query.strip():
        raise ValueError("search_string must not be empty")
    if not 1 <= top_k <= 15:
        raise ValueError(f"top_k must be between 1 and 15, got {top_k}")
    return search.hybrid(chunks.where(F.col("doc_id") == doc_id), query, top_k, **kw)


def resolve(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which candidate (doc_id: UUID text) each request (request_id, raw) means: request_id, doc_id, error.

    A text with 28 or more hexadecimal digits is an id, padded with zeros, and must be a
    candidate (``not_in_chat`` otherwise). One of 16 to 27 digits must begin exactly one
    candidate's id (``ambiguous``, ``invalid``). Shorter ones are ``invalid``. Without any
    candidates an id is answered by ``no_documents``. Requests meet candidates on their first 16 digits.
    """
    digits = F.regexp_replace(F.lower(F.regexp_replace("raw", r"</?[A-Za-z0-9_]+>", "")), "[^0-9a-f]", "")
    rows = requests.select("request_id", digits.alias("d")).withColumn("start", F.substring("d", 1, 16)).where("d IS NOT NULL")
    known = candidates.select("doc_id", F.lower(F.replace("doc_id", F.lit("-"), F.lit(""))).alias("hex")).distinct().withColumn("start", F.substring("hex", 1, 16))
    full = F.length("d") >= 28
    hit = F.when(full, F.col("hex") == F.rpad("d", 32, "0")).otherwise(F.startswith("hex", F.col("d")))
    found = rows.where("length(d) >= 16").join(known, "start").where(hit).groupBy("request_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    some = candidates.limit(1).agg(F.count("*").alias("some"))  # one row
    out = rows.join(found, "request_id", "left").crossJoin(F.broadcast(some))
    error = F.when(F.col("n") == 1, None).when(F.col("n") > 1, "ambiguous").when((F.length("d") >= 16) & (F.col("some") == 0), "no_documents").when(full, "not_in_chat").otherwise("invalid")
    return out.select("request_id", F.when(F.col("n") == 1, F.col("doc_id")).alias("doc_id"), error.alias("error"))


def resolve_in_scope(requests: DataFrame, selected: DataFrame, visible: DataFrame, documents: DataFrame) -> DataFrame:
    """Which document (UUID text) each request (request_id, user_id, raw) means: request_id, doc_id, error.

    First among the documents of the collections that the user has ``selected`` (user_id, doc_id), by the rules of
    ``resolve``. A whole id that isn't among them may still be any document that the user may see: ``visible``
    (user_id, doc_id). Otherwise it does not exist among ``documents`` (``no_such_document``) or is another's (``no_access``).
    """
    hexa = lambda c: F.lower(F.replace(c, F.lit("-"), F.lit("")))
    digits = F.regexp_replace(F.lower(F.regexp_replace("raw", r"</?[A-Za-z0-9_]+>", "")), "[^0-9a-f]", "")
    rows = requests.select("request_id", "user_id", digits.alias("d")).where("d IS NOT NULL").withColumn("whole", F.length("d") >= 28)
    rows = rows.withColumn("wanted", F.when(F.col("whole"), F.substring(F.rpad("d", 32, "0"), 1, 32)).otherwise(F.col("d"))).withColumn("start", F.substring("d", 1, 16))
    own = selected.select("user_id", F.col("doc_id").alias("near"), hexa("doc_id").alias("hex")).distinct().withColumn("start", F.substring("hex", 1, 16))
    hit = F.when(F.col("whole"), F.col("hex") == F.col("wanted")).otherwise(F.startswith("hex", F.col("wanted")))
    found = rows.where("length(d) >= 16").join(own, ["user_id", "start"]).where(hit).groupBy("request_id").agg(F.count("*").alias("n"), F.min("near").alias("near"))
    may = visible.select("user_id", hexa("doc_id").alias("wanted"), F.col("doc_id").alias("far")).distinct()
    known = documents.select(hexa("doc_id").alias("wanted"), F.lit(True).alias("known")).distinct()
    some = selected.groupBy("user_id").agg(F.lit(True).alias("some"))
    out = rows.join(found, "request_id", "left").join(may, ["user_id", "wanted"], "left").join(known, "wanted", "left").join(some, "user_id", "left")
    doc = F.when(F.col("n") == 1, F.col("near")).when(F.col("whole"), F.col("far"))
    error = F.when(doc.isNotNull(), None).when(F.col("n") > 1, "ambiguous").when(F.col("whole") & F.col("known"), "no_access").when(F.col("whole"), "no_such_document").when((F.length("d") >= 16) & F.col("some").isNull(), "no_documents").otherwise("invalid")
    return out.select("request_id", doc.alias("doc_id"), error.alias("error"))


def name_key(name: Column) -> Column:
    """A file's or collection's name without folders and ``.md``, lower-cased, with single underscores for spaces and dashes."""
    last = F.regexp_replace(F.trim(name), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(last, r"(?i)\.md$", "")), r"[\s_-]+", "_"), "^_|_$", "")


def skill_text(title: Column, text: Column) -> Column:
    """A skill document as part of a prompt: its name, description and body; null without a body."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    meta = T.front_matter(raw)
    body = F.regexp_replace(F.when(F.size(meta) > 0, F.regexp_replace(raw, r"(?s)^---\n.*?\n---(\n|$)", "")).otherwise(raw), r"^\s+|\s+$", "")
    get = lambda k: F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit(""))
    plain = F.initcap(F.replace(F.regexp_replace(name_key(title), "_skill$", ""), F.lit("_"), F.lit(" ")))
    name = F.coalesce(get("name"), get("title"), get("id"), F.nullif(plain, F.lit("")), F.lit("Collection Skill"))
    return F.when(body != "", F.concat_ws("\n\n", F.concat(F.lit("## Collection Skill: "), name), F.concat(F.lit("Description:\n"), get("description")), body))


def skills(collections: DataFrame, documents: DataFrame, selected: DataFrame, most: int = SKILL_CHARS) -> DataFrame:
    """Prompt of the skills in each user's selected collections: user_id, prompt.

    ``collections`` (id, parent_id, name), ``documents`` (collection_id, title, text,
    is_text), ``selected`` (user_id, collection_id), those the user may see. Of a selected
    collection the documents named as skills count, of one named as a skill pack every text
    document; then come the packs right below them. In order of collection name, id and title.
    """
    pack = name_key(F.col("name")).isin(*SKILL_PACKS)
    c = collections.select(F.col("id").alias("collection_id"), "parent_id", "name", pack.alias("pack"))
    own = selected.distinct().join(c, "collection_id").select("user_id", F.lit(0).alias("phase"), "name", "collection_id", "pack")
    below = selected.distinct().withColumnRenamed("collection_id", "parent_id").join(c.where("pack"), "parent_id").select("user_id", F.lit(1).alias("phase"), "name", "collection_id", "pack")
    key = name_key(F.col("title"))
    marked = key.isin(*SKILL_NAMES) | F.endswith(key, F.lit("_skill"))
    text_doc = F.col("is_text") | F.endswith(F.lower(F.trim("title")), F.lit(".md"))
    docs = documents.select("collection_id", "title", marked.alias("marked"), text_doc.alias("plain"), skill_text(F.col("title"), F.col("text")).alias("part")).where("part IS NOT NULL AND (marked OR plain)")
    # Users take a collection's documents in one order, so what begins beyond a prompt's length in its collection is left out before
    # users meet documents. A collection is first dealt into parts: what is beyond in its part is beyond in the collection.
    docs = docs.join(c.select("collection_id", "pack"), "collection_id").where("CASE WHEN pack THEN plain ELSE marked END")
    docs = docs.select("collection_id", "title", F.left("part", F.lit(most)).alias("part"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("deal"))
    for group in (["collection_id", "deal"], ["collection_id"]):
        ahead = F.sum(F.length("part") + len(BETWEEN)).over(Window.partitionBy(*group).orderBy("title", "part").rowsBetween(Window.unboundedPreceding, -1))
        docs = docs.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < most).drop("ahead")
    rows = own.union(below).join(docs.drop("deal"), "collection_id")
    # What begins beyond the prompt's length can't be in it, so it is left out before anything is gathered.
    keys = ["phase", "name", "collection_id", "title", "part"]
    before = F.coalesce(F.sum(F.length("part") + len(BETWEEN)).over(Window.partitionBy("user_id").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") < most).withColumn("part", F.left("part", F.lit(most)))
    ordered = F.array_sort(F.collect_list(F.struct("before", "part")))
    prompt = F.array_join(F.transform(ordered, lambda x: x["part"]), BETWEEN)
    return rows.groupBy("user_id").agg(F.rtrim(F.substring(prompt, 1, most)).alias("prompt"))


def quote(message: Column, chunk: Column) -> Column:
    """The sentence of a chunk that shares most with a message, the first of equals; null if none shares a word. It stands for a model that picks a quote."""
    parts = F.filter(F.split(F.regexp_replace(T.squeeze(chunk), r"([.!?]) ", "$1\n"), "\n"), lambda s: s != "")
    scored = lambda words: F.transform(parts, lambda s, i: F.struct(T.overlap_with(words, s).alias("score"), (-i).alias("place"), s.alias("sentence")))
    best = F.array_max(T.bound(T.lexical_words(message), scored))
    return T.bound(best, lambda x: F.when(x["score"] > 0, x["sentence"]))
