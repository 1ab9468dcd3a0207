"""Quality rules under weak supervision.

Each rule looks at one ratio of a whole text and votes good, votes bad or
abstains. What its votes are worth is estimated, not set: expectation-maximisation over
the vote patterns of all documents gives, for good and for bad documents, the share of
each rule's three votes. A rule is trusted as far as the others agree with it, so one bad
vote of a weak rule is outvoted by good votes of strong ones, and a document that good
rules abstain on loses without a single bad vote, as good documents rarely leave them
undecided. The posterior probability of being good takes the place of passing every
rule. Only counts of vote patterns reach the driver: at most ``3 ** len(RULES)`` rows,
however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.stats import stream

GOOD, ABSTAIN, BAD = 0, 1, 2

#: Rule: (numerator, denominator, good from, good to, bad below, bad above); it abstains between, and on a zero denominator.
RULES = {
    "symbols": ("n_symbols", "n_chars", 0.0, 0.005, -1.0, 0.03),
    "symbol_words": ("n_symbol_words", "n_words", 0.0, 0.02, -1.0, 0.2),
    "upper_case": ("n_upper", "n_letters", 0.002, 0.06, -1.0, 0.25),
    "marks": ("n_marks", "n_words", 0.0, 0.05, -1.0, 0.3),
    "punctuation": ("n_punct", "n_words", 0.08, 0.3, 0.02, 0.6),
    "word_length": ("word_chars", "n_words", 4.4, 7.0, 3.0, 10.0),
    "distinct_words": ("n_distinct_words", "n_words", 0.55, 0.95, 0.2, 2.0),
    "top_word": ("n_top_word", "n_words", 0.0, 0.1, -1.0, 0.3),
    "same_next": ("n_same_next", "n_words", 0.0, 0.03, -1.0, 0.15),
    "repeats": ("n_repeat_words", "n_words", 0.0, 0.02, -1.0, 0.2),
    "dup_lines": ("n_dup_lines", "n_lines", 0.0, 0.1, -1.0, 0.3),
}
#: Where EM starts: shares of (good, abstain, bad) votes on good and on bad documents, share of good documents; documents' worth of belief in it.
START, START_GOOD, BELIEF = ((0.8, 0.18, 0.02), (0.4, 0.3, 0.3)), 0.8, 10.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def votes(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Vote of every rule (columns) on every row."""
    out = []
    for num, den, good_from, good_to, below, above in RULES.values():
        x = counts[num] / np.maximum(counts[den], 1)
        v = np.full(len(x), ABSTAIN, np.int64)
        v[(x >= good_from) & (x <= good_to)] = GOOD
        v[(x < below) | (x > above)] = BAD
        v[counts[den] == 0] = ABSTAIN
        out.append(v)
    return np.stack(out, axis=1)


@dataclass
class Model:
    """Share of good documents, and votes[class (good, bad), rule, vote] as shares."""

    good: float
    votes: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with the votes ``v`` (a row each) is good."""
        odds = np.log(self.votes[0]) - np.log(self.votes[1])
        x = np.log(self.good) - np.log1p(-self.good) + odds[np.arange(v.shape[1]), v].sum(1)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 100) -> Model:
    """EM over distinct vote patterns and how many documents have each.

    The start fixes which class is called good. Without documents the starting model is
    returned.
    """
    start = np.repeat(np.array(START)[:, None, :], patterns.shape[1], 1)
    model = Model(START_GOOD, start)
    cast = np.stack([patterns == v for v in (GOOD, ABSTAIN, BAD)], axis=2).astype(float)
    for _ in range(rounds if len(weight) else 0):
        p = model.posterior(patterns)
        seen = np.einsum("cp,prv->crv", np.stack([weight * p, weight * (1 - p)]), cast) + BELIEF * start
        model = Model(float((weight @ p + BELIEF * START_GOOD) / (weight.sum() + BELIEF)), seen / seen.sum(2, keepdims=True))
    return model


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = 3 ** np.arange(len(RULES))
    for b in batches:
        for first, counts in stream(b.column(1)):
            n = len(counts["n_words"])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), *(pa.array(counts[c].astype(np.int64)) for c in BASE), pa.array((votes(counts) * power).sum(1))], ["doc_id", *BASE, "pattern"])


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Votes, posterior and verdict for each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, the base counts (long), base_failed, kept, posterior and pattern (the
    votes as digits to the base of 3, the first rule's the lowest). Null text
    counts as empty: all counts are 0, base_failed is true. Repeated rows and rows without
    doc_id are judged like any other. An empty table gives an empty result.
    """
    m = len(RULES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(_vote, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", pattern long"), "votes")
    found = rows.groupBy("pattern").count().collect()  # at most 3 ** m
    code, weight = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], float)
    patterns = code[:, None] // 3 ** np.arange(m) % 3
    p = fit(patterns, weight).posterior(patterns) if len(code) else np.zeros(0)
    spark = docs.sparkSession
    known = spark.createDataFrame([(int(c), float(x)) for c, x in zip(code, p)], "pattern long, posterior double")
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    out = rows.join(F.broadcast(known), "pattern", "left")
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), F.round("posterior", 9).alias("posterior"), "pattern")
