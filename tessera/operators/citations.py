"""Citations of answers: allowed ones, lines that lack one, enforcement, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: A citation, one of a full id, how a list item begins; messages and rows that count for what is allowed, references of a prompt.
TOKEN, FULL_TOKEN = r"\[doc:[^\]\s]+\s+chunk:[0-9]+\]", r"\[doc:([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\s+chunk:([0-9]+)\]"
ITEM = r"^([-*]\s+|[0-9]+\.\s+)"
MESSAGES, ROWS, REFERENCES = 4, 40, 24


def used(text: Column) -> Column:
    """Citations of a text in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def allowed(results: DataFrame) -> DataFrame:
    """Citations an answer may use: conv_id, allowed (sorted), from the first 40 rows of a conversation's last four tools' results (conv_id, turn, row_no, citation, doc_id, chunk_id)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = results.withColumn("back", F.dense_rank().over(w)).where((F.col("back") <= MESSAGES) & (F.col("row_no") < ROWS))
    named = F.nullif(F.regexp_extract(F.coalesce("citation", F.lit("")), f"({TOKEN})", 1), F.lit(""))
    built = F.when((F.trim("doc_id") != "") & F.trim("chunk_id").rlike("^[0-9]+$"), F.concat(F.lit("[doc:"), F.trim("doc_id"), F.lit(" chunk:"), F.trim("chunk_id"), F.lit("]")))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.coalesce(named, built))).alias("allowed"))


def uncited(answers: DataFrame) -> DataFrame:
    """List items that state something without a citation: id, line_no, line, of ``answers`` (id, text).

    Code blocks, headings, images, items that end with a colon and those under three words
    are no claims. An indented item may rest on the citation of the last line before it that
    is no item.
    """
    rows = answers.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line_no", "raw"))
    rows = rows.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    upto = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith("line", F.lit("```"))
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(upto))
    said = ~fence & (F.col("fences") % 2 == 0) & (F.col("line") != "") & ~F.col("line").rlike(r"^(#|!\[)")
    cites, item = F.col("line").rlike(TOKEN), F.col("line").rlike(ITEM)
    rows = rows.withColumn("rests", F.coalesce(F.last(F.when(said & ~item, cites), ignorenulls=True).over(upto), F.lit(False)))
    claim = said & item & ~F.endswith("line", F.lit(":")) & F.col("line").rlike("[A-Za-z]") & (F.regexp_count("line", F.lit("[A-Za-z0-9]+")) >= 3)
    return rows.where(claim & ~cites & ~(F.col("rests") & F.col("raw").rlike(r"^\s"))).select("id", "line_no", "line")


def checked(answers: DataFrame) -> DataFrame:
    """Whether each answer (id, text, allowed) is cited as required: id, invalid (distinct, in order), n_uncited, passed. Without allowed citations all pass."""
    bare = uncited(answers.select("id", "text")).groupBy("id").agg(F.count("*").alias("n_uncited"))
    own = used(F.coalesce("text", F.lit("")))
    rows = answers.select("id", "allowed", own.alias("used"), F.array_except(own, "allowed").alias("invalid")).join(bare, "id", "left").withColumn("n_uncited", F.coalesce("n_uncited", F.lit(0)))
    good = (F.size("used") > 0) & (F.size("invalid") == 0) & (F.col("n_uncited") == 0)
    return rows.select("id", "invalid", "n_uncited", ((F.size("allowed") == 0) | good).alias("passed"))


def allow_list(allowed: Column) -> Column:
    """The first 24 allowed citations by order of text, a line each."""
    return F.array_join(F.slice(F.array_sort(allowed), 1, REFERENCES), "\n")


def linked(text: Column, pattern: str) -> Column:
    """Citations of full ids as links; ``pattern`` is the document's address with ``{id}``."""
    href = pattern.replace("{id}", "$1") + "?chunk=$2"
    return F.regexp_replace(text, FULL_TOKEN, f'<a href="{href}" data-doc-id="$1" data-chunk-id="$2">[doc:$1 chunk:$2]</a>')


def figure(caption: Column, url: Column) -> Column:
    """An image in markdown; the caption squeezed to 80 characters, ``Image`` without one."""
    short = F.substring(F.regexp_replace(T.squeeze(caption), r"[\[\]]", ""), 1, 80)
    return F.concat(F.lit("!["), F.coalesce(F.nullif(short, F.lit("")), F.lit("Image")), F.lit("]("), url, F.lit(")"))
