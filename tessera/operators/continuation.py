"""A text that goes on after an earlier one: what it adds, and how the two join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least common beginning that is dropped; overlaps up to SHORT count from LEAST characters, longer ones from a SHARE-th of the shorter text, MOST at most; characters looked at on both sides of a seam.
SAME_START, LEAST, SHORT, SHARE, MOST, SEAM = 24, 3, 12, 8, 96, 48
#: Fixed patterns: ends after which nothing need come between (white, an image's link, an open mark), beginnings before which nothing need, doubled percentages.
ENDS_OPEN = r"(?s)(^|[\n ]|!\[[^\]]*\]\([^)]*|[&*(\[{\-—]\s*)\z"
STARTS_CLOSED = r"^[)\]/.,:;!?]"
DOUBLED = r"([0-9]+(?:\.[0-9]+)?%)\1+"


def border(left: Column, right: Column) -> Column:
    """Length of the longest end of ``left`` that begins ``right``; 0 without."""
    lengths = F.filter(F.sequence(F.lit(0), F.least(F.length(left), F.length(right))), lambda n: F.endswith(left, F.left(right, n)))
    return F.coalesce(F.array_max(lengths), F.lit(0))


def common_start(left: Column, right: Column) -> Column:
    """Length of the longest common beginning, by halving: texts with n characters in common have any fewer in common."""
    least = F.least(F.length(left), F.length(right))
    bits = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda i: F.expr("1").cast("long") * F.pow(F.lit(2), i).cast("long"))
    grown = F.aggregate(bits, F.lit(0).cast("long"), lambda n, bit: F.when((n + bit <= least) & (F.left(left, (n + bit).cast("int")) == F.left(right, (n + bit).cast("int"))), n + bit).otherwise(n))
    return grown.cast("int")


def continue_text(rows: DataFrame) -> DataFrame:
    """``following`` as a continuation of ``previous``: id, rest (what it adds), separator, merged. Null texts count as empty.

    It adds nothing if it only repeats the beginning of what there is. Else a full repetition,
    a long common beginning and then an overlap at the seam are dropped. A line break comes between the parts unless the
    first ends open or the second begins with what closes; percentages that the seam doubles are written once.
    """
    f = F.col
    texts = rows.select("id", F.coalesce("previous", F.lit("")).alias("previous"), F.coalesce("following", F.lit("")).alias("following"))
    texts = texts.withColumn("new", F.regexp_replace("following", r"^[\r\n]+", "")).withColumn("old", F.regexp_replace("previous", r"^[\r\n]+", ""))
    texts = texts.withColumn("state", F.expr("CASE WHEN previous = '' OR following = '' THEN 'alone' WHEN startswith(old, new) THEN 'told' WHEN startswith(new, previous) THEN 'whole' ELSE 'part' END"))
    same = common_start(f("old"), f("new"))
    gone = F.when(f("state") == "whole", F.length("previous")).when((f("state") == "part") & (F.left("old", F.lit(SAME_START)) == F.left("new", F.lit(SAME_START))) & (same >= SAME_START), same).otherwise(0)
    texts = texts.withColumn("new", F.substring("new", gone + 1, F.length("new")))
    texts = texts.withColumn("met", F.when(f("state").isin("whole", "part"), border(f("previous"), f("new"))).otherwise(0))
    shorter = F.least(F.length("previous"), F.length("new"))
    counts = f("met") >= F.when(f("met") <= SHORT, LEAST).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(shorter / SHARE))))
    left = F.regexp_replace(F.substring("new", F.when(counts, f("met")).otherwise(0) + 1, F.length("new")), r"^[\r\n]+", "")
    texts = texts.withColumn("rest", F.when(f("state") == "alone", f("following")).when(f("state") == "told", "").otherwise(left))
    no_break = f("previous").rlike(ENDS_OPEN) | f("rest").rlike(STARTS_CLOSED) | (F.regexp_count("previous", F.lit(r"\*\*")) % 2 == 1)
    texts = texts.withColumn("separator", F.when(no_break, "").otherwise("\n"))
    whole = F.concat("previous", F.when(f("rest") != "", f("separator")).otherwise(""), "rest")
    texts = texts.withColumn("whole", whole).withColumn("from", F.greatest(F.lit(0), F.length("previous") - SEAM))
    window = F.substring("whole", f("from") + 1, F.length("previous") + SEAM - f("from"))
    mended = F.concat(F.left("whole", f("from")), F.regexp_replace(window, DOUBLED, "$1"), F.substring("whole", F.length("previous") + SEAM + 1, F.length("whole")))
    return texts.select("id", "rest", "separator", F.when((f("previous") == "") | (f("rest") == ""), f("whole")).otherwise(mended).alias("merged"))
