"""Around an answer: sources, figures, notices, recent evidence, memory lines, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import speech as S
from tessera.functions import text as T
from tessera.operators.ordering import ranked


def titles_to_ids(docs: DataFrame, group: str) -> DataFrame:
    """For each group a map of title to doc_id; of equal titles the last by doc_id wins."""
    last = docs.groupBy(group, "title").agg(F.max("doc_id").alias("doc_id"))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "doc_id")))).alias("ids"))


def last_known(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """The last value that isn't null at or before each row."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"last_{column}", F.last(column, ignorenulls=True).over(w))


def recent(evidence: DataFrame, messages: int = 4, per_message: int = 12, most: int = 10) -> DataFrame:
    """Snippets of the evidence (conv_id, turn, row_no, source, text) of the last messages, distinct by their first 180 characters, newest message first: conv_id, n, source, text. Evidence without a useful sentence gives none."""
    by_conv = Window.partitionBy("conv_id")
    rows = evidence.withColumn("back", F.dense_rank().over(by_conv.orderBy(F.desc("turn")))).where((F.col("back") <= messages) & (F.col("row_no") < per_message))
    rows = rows.withColumn("text", T.snippet(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", F.substring("text", 1, 180)).orderBy("back", "row_no"))).where("again = 1")
    return rows.withColumn("n", F.row_number().over(by_conv.orderBy("back", "row_no"))).where(F.col("n") <= most).select("conv_id", "n", "source", "text")


#: A link to a document's image, whose id it holds; an image in markdown and its link (fixed patterns).
IMAGE_OF = r"/document_image/([^/]+)/"
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
LINK_AT_END = r"\(([^)]+)\)$"
#: Rows of a result that are looked through (fixed value).
RESULT_ROWS = 40


def document_ref(doc_id: Column) -> Column:
    """``[doc:<id>]``; null without an id."""
    return F.when(F.trim(doc_id) != "", F.concat(F.lit("[doc:"), F.trim(doc_id), F.lit("]")))


def image_ref(link: Column) -> Column:
    """The reference of the document whose image a link shows; null for other links."""
    return document_ref(F.nullif(F.regexp_extract(link, IMAGE_OF, 1), F.lit("")))


def source_refs(arguments: Column, result: Column) -> Column:
    """Sorted references of the documents that a tool's call or its result names, both JSON: the call's ``doc_id``, the rows' ids and images; for a result that is one text its image."""
    get = lambda x, *names: F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in names))
    body = F.ltrim(F.coalesce(result, F.lit("")))
    rows = F.when(F.startswith(body, F.lit("{")), F.array(body)).when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>"))
    rows = F.slice(F.filter(F.coalesce(rows, F.array().cast("array<string>")), lambda x: F.startswith(F.ltrim(x), F.lit("{"))), 1, RESULT_ROWS)
    found = F.flatten(F.transform(rows, lambda x: F.array(document_ref(get(x, "doc_id", "d")), image_ref(get(x, "image_url", "u")))))
    found = F.array_compact(F.concat(F.array(document_ref(F.get_json_object(arguments, "$.doc_id"))), found))
    alone = F.when(F.startswith(body, F.lit('"')), image_ref(body))
    return F.array_sort(F.array_distinct(F.when(F.size(found) == 0, F.array_compact(F.array(alone))).otherwise(found)))


def shown_refs(text: Column) -> Column:
    """Sorted references of the documents whose images a text shows."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), image_ref))))


def with_sources(text: Column, allowed: Column) -> Column:
    """An answer with the allowed references it uses, all if it uses none, listed at its end. A list that names one of them stays as it is; to one that names none the references are added."""
    base = F.rtrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", ""))
    used = F.array_intersect(T.citations(base), allowed)
    refs = F.array_sort(F.when(F.size(used) > 0, used).otherwise(allowed))
    lines = F.concat(F.lit("- "), F.array_join(refs, "\n- "))
    listed = F.contains(base, F.lit("Sources:"))
    named = F.exists(refs, lambda r: F.contains(F.substring_index(base, "Sources:", -1), r))
    added = F.when(~listed, F.concat(base, F.lit("\n\nSources:\n"), lines)).when(named, base).otherwise(F.concat(base, F.lit("\n"), lines))
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) <= 0, base).otherwise(added)


def figure_lines(chunks: Column, links: Column, prefix: str, most: int = 3) -> Column:
    """Markdown of at most ``most`` distinct images: those of chunks (structs of image_url, u, title, text) whose link begins with ``prefix``, named by title or text, then ``links`` as they are."""
    some = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))

    def line(chunk: Column) -> Column:
        link = some(chunk["image_url"], chunk["u"])
        name = F.regexp_replace(F.coalesce(some(chunk["title"], chunk["text"]), F.lit("Figure")), r"^\s+|\s+$", "")
        name = F.coalesce(F.nullif(F.substring(F.replace(name, F.lit("\n"), F.lit(" ")), 1, 80), F.lit("")), F.lit("Figure"))
        return F.when(F.startswith(link, F.lit(prefix)), F.struct(link.alias("link"), F.concat(F.lit("!["), name, F.lit("]("), link, F.lit(")")).alias("line")))

    of_links = F.transform(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.struct(x.alias("link"), F.concat(F.lit("![Figure]("), x, F.lit(")")).alias("line")))
    found = F.concat(F.array_compact(F.transform(chunks, line)), of_links)
    first = F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["link"]), x["link"]) == i + 1)
    return F.slice(F.transform(first, lambda x: x["line"]), 1, most)


def with_figures(answer: Column, lines: Column) -> Column:
    """An answer with the images of ``lines`` whose links it doesn't show in markdown."""
    base = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+$", "")
    shown = F.regexp_extract_all(base, F.lit(IMAGE), F.lit(1))
    added = F.array_join(F.filter(lines, lambda x: ~F.array_contains(shown, F.regexp_extract(x, LINK_AT_END, 1))), "\n")
    return F.when(added == "", base).when(base == "", added).otherwise(F.concat(base, F.lit("\n\n"), added))


def recent_images(rows: DataFrame, messages: int = 4, most: int = 3) -> DataFrame:
    """Images of the last results, as markdown: of rows (conv_id, turn, place, link, caption) with a link that is no data and a caption worth showing, each link once, newest message first: conv_id, n, line."""
    by_conv = Window.partitionBy("conv_id")
    found = rows.withColumn("back", F.dense_rank().over(by_conv.orderBy(F.desc("turn")))).where(F.col("back") <= messages)
    caption = F.substring(F.regexp_replace(F.coalesce("caption", F.lit("Image")), r"^\s+|\s+$", ""), 1, 80)
    found = found.withColumn("caption", caption).where("link <> '' AND NOT startswith(link, 'data:image/')").where(S.caption_shown(F.col("caption"), T.useful_sentence(F.col("caption"))))
    found = found.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "link").orderBy("back", "place"))).where("again = 1")
    found = found.withColumn("n", F.row_number().over(by_conv.orderBy("back", "place"))).where(F.col("n") <= most)
    return found.select("conv_id", "n", F.concat(F.lit("!["), F.replace("caption", F.lit("\n"), F.lit(" ")), F.lit("]("), F.col("link"), F.lit(")")).alias("line"))


#: Tools that search documents (fixed names).
RETRIEVAL_TOOLS = ("vector_search", "search_single_document", "more_context", "whole_document", "document_ids")


def notice(tool: Column, error: Column, status: Column, message: Column) -> Column:
    """What a document tool's result has to tell: that it failed, or its own message when it found nothing; else an empty text."""
    some = lambda x: F.trim(F.coalesce(x, F.lit("")))
    failed = F.concat(F.lit("The document search tool failed: "), some(error))
    told = F.when(some(error) != "", failed).when(some(status) == "no_results", some(message)).otherwise("")
    return F.when(some(tool).isin(*RETRIEVAL_TOOLS), told).otherwise("")


def with_notice(text: Column, notice: Column) -> Column:
    """A text that ends with the notice, unless it says it already, in whatever case."""
    base, told = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", ""), F.trim(F.coalesce(notice, F.lit("")))
    return F.when((told == "") | F.contains(F.lower(base), F.lower(told)), base).when(base == "", told).otherwise(F.concat(base, F.lit("\n\n"), told))


def from_end(messages: DataFrame, budget: int) -> DataFrame:
    """The longest run of closing turns (conv_id, turn, tokens) within a token budget; the last turn always."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("back", F.row_number().over(w))
    return rows.where((F.col("used") <= budget) | (F.col("back") == 1)).select("conv_id", "turn")


def with_ancestors(selected: DataFrame, up: DataFrame) -> DataFrame:
    """Selected nodes (id) and all above them; ``up`` as ``access.ancestors`` gives it."""
    return selected.join(up, "id").select(F.col("ancestor_id").alias("id")).distinct()


def resolve_paths(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """Collections for wanted paths: the same path, else the least id whose path ends with it."""
    exact = wanted.join(paths.select(F.col("path").alias("wanted"), F.col("id").alias("hit")), "wanted", "left")
    last = F.element_at(F.split("path", "/"), -1)
    tails = paths.select("id", "path", last.alias("leaf"))
    ends = wanted.withColumn("leaf", F.element_at(F.split("wanted", "/"), -1)).join(tails, "leaf").where(F.expr("endswith(path, '/' || wanted)")).groupBy("wanted").agg(F.min("id").alias("guess"))
    return exact.join(ends, "wanted", "left").select("wanted", F.coalesce("hit", "guess").alias("id"))


def sorted_page(rows: DataFrame, column: str, page: int, size: int = 25, descending: bool = False, kind: str = "name") -> DataFrame:
    """A page of rows by a column, then id: a ``name`` or ``type`` whatever its case (null as empty), or a ``date`` (one that is none counts as the epoch). A page beyond the end is the last one.

    Rows are ranked by ranges of the order, so no task sees them all and a deep page costs what the first does.
    """
    text = F.col(column).cast("string")
    key = F.coalesce(F.unix_micros(text.try_cast("timestamp")), F.lit(0)) if kind == "date" else F.lower(F.coalesce(text, F.lit("")))
    placed = ranked(rows.withColumn("_key", key), F.desc("_key") if descending else F.asc("_key"), "id", name="_place").drop("_key")
    last = placed.agg(F.max("_place")).first()[0] or 0
    page = max(1, min(page, -(-last // size)))
    return placed.where(F.col("_place").between((page - 1) * size + 1, page * size)).orderBy("_place").drop("_place")
