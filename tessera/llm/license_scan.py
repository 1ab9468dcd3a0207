"""License scans: an exact set-similarity join of text blocks with license texts.

A template's blocks are all runs of twice its number of words (fewer at a text's end) that
begin with one of its words, so no passage that holds the template can straddle two. A
block matches if it holds at least ``percent`` per cent of the template's distinct words
(``need`` of them) and all its telling phrases, and if none of its excluding ones stands in it
or within a template's length of it.

The template's words are ordered by how often they occur in the whole corpus, rarest
first. A matching block must hold one of the first ``n - need + 1``: a text without one of
these is never looked at again (prefix filter). A block must
have ``need`` words left in the text (length filter), and the ``need - 1``-th template word
after its first must still stand inside it (positional filter: what is left of the block
after the first match bounds the overlap). What remains is counted exactly.

Templates are parameters of bounded number and length, so their prefixes are an index in
the plan itself: each text is judged in one pass within its row, without shuffles,
whatever its length. Only the counts of template words reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.licenses import TEMPLATES, Template

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All but digits, a-z and what is not ASCII separates words of a lower-cased text.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase and label that count wherever the words stand consecutively.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
PERCENT = 80


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def split(text: str) -> list[str]:
    """``words`` of a parameter."""
    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]


def frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each word of ``vocabulary`` occurs in all texts; at most that many rows reach the driver."""
    some = docs.select(words(F.col("text")).alias("words")).select(F.expr(f"explode(filter(words, w -> w IN ({_texts(vocabulary)})))").alias("w"))
    return {r[0]: r[1] for r in some.groupBy("w").count().collect()}


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _texts(values: Sequence[str]) -> str:
    """SQL list of words or phrases, which have no quotes or backslashes by ``split``."""
    return ", ".join(f"'{v}'" for v in values)


def _share(tokens: list[str], length: int, need: int, prefix: list[str], telling: Sequence[str], excluding: Sequence[str]) -> str:
    """SQL of the greatest share of a template in a block that matches, else null; over ``words`` and ``rare``, the row's words that any prefix has.

    For each hit ``x``, the ``k``-th of a text's template words ``hits``, the block that begins there.
    """
    block = f"transform(filter(slice(hits, k + 1, {2 * length}), y -> y.i < x.i + {2 * length}), y -> y.w)"
    text = f"concat(' ', array_join(slice(words, x.i + 1, {2 * length}), ' '), ' ')"
    told = "".join(f" AND contains({text}, ' {' '.join(split(p))} ')" for p in telling)
    near = f"concat(' ', array_join(slice(words, greatest(0, x.i - {length}) + 1, least(x.i, {length}) + {3 * length}), ' '), ' ')"
    told += "".join(f" AND NOT contains({near}, ' {' '.join(split(p))} ')" for p in excluding)
    left = f"size(words) - x.i >= {need} AND get(hits, k + {need - 1}).i < x.i + {2 * length}"
    overlap = f"CASE WHEN {left} AND arrays_overlap({block}, array({_texts(prefix)})){told} THEN size(array_distinct({block})) END"
    hits = f"filter(transform(words, (w, i) -> struct(w, i)), y -> y.w IN ({_texts(tokens)}))"
    # An array of one element, so that the hits are worked out once.
    most = f"array_max(transform(array({hits}), hits -> array_max(transform(hits, (x, k) -> {overlap}))))"
    return f"CASE WHEN exists(rare, w -> w IN ({_texts(prefix)})) THEN get(filter(array({most}), m -> m >= {need}), 0) / double({len(tokens)}) END"


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Licenses named in each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, n_base (places of phrases), first_word and last_word (least
    and greatest start, words from 0; null without a place), base_labels, labels (with the
    templates'; distinct, sorted, comma-joined), score (1 with a place, else the greatest
    share of a template found at the threshold, else 0). Null and empty texts have no
    words and no labels. Repeated rows and rows without doc_id are judged like any other.
    An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    wanted = [(t.label, list(dict.fromkeys(split(t.text))), len(split(t.text)), t.telling, t.excluding) for t in templates]
    freq = frequencies(docs, sorted({w for _, t, *_ in wanted for w in t})) if wanted else {}

    plans = []
    for label, tokens, length, telling, excluding in wanted:
        need = -(-percent * len(tokens) // 100)
        order = sorted(tokens, key=lambda w: (freq.get(w, 0), w))
        plans.append((label, tokens, length, need, order[: len(order) - need + 1], telling, excluding))
    prefixes = sorted({w for p in plans for w in p[4]})
    rows = docs.select("doc_id", words(F.col("text")).alias("words"))
    rows = rows.withColumn("rare", F.expr(f"filter(words, w -> w IN ({_texts(prefixes)}))") if prefixes else F.array().cast("array<string>"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    # One pass for all templates, and none where a text has no rare word: its shares are null.
    rows = rows.withColumn("shares", F.expr(f"CASE WHEN size(rare) > 0 THEN array({', '.join(_share(*p[1:]) for p in plans)}) END" if plans else "CAST(NULL AS array<double>)"))
    matched = F.expr(f"array_compact(transform(shares, (s, k) -> CASE WHEN s > 0 THEN get(array({_texts([p[0] for p in plans])}), k) END))" if plans else "CAST(NULL AS array<string>)")

    count, first, last, found = [], [], [], []
    for phrase, label in phrases:
        whole, n = f" {phrase} ", len(phrase.split())
        has = F.contains(F.col("joined"), F.lit(whole))
        back = F.reverse("joined")
        count.append(F.when(has, F.regexp_count("joined", F.lit(f" {re.escape(phrase)}(?= )"))).otherwise(0))
        first.append(F.when(has, _spaces(F.substring("joined", F.lit(1), F.instr("joined", whole))) - 1))
        last.append(F.when(has, F.size("words") - _spaces(F.substring(back, F.lit(1), F.instr(back, whole[::-1]))) + 1 - n))
        found.append(F.when(has, F.lit(label)))
    total = sum(count, F.lit(0)).cast("long")
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.lit(None).cast("int")
    rows = rows.withColumn("found", F.array_compact(F.array(*found).cast("array<string>")))
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), total.alias("n_base"), F.least(none, none, *first).cast("long").alias("first_word"),
        F.greatest(none, none, *last).cast("long").alias("last_word"), join(F.col("found")).alias("base_labels"), join(F.concat("found", F.coalesce(matched, F.array().cast("array<string>")))).alias("labels"),
        F.when(total > 0, 1.0).otherwise(F.coalesce(F.array_max("shares"), F.lit(0.0))).alias("score"),
    )
