"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are cut into at most ``bins`` quantile bins. Trees are grown depth-first
by levels on sums of gradients and second derivatives per (node, bin), and kept as
flat arrays, complete binary trees of one depth, so that a batch walks all trees by
array indexing. Training runs in numpy on the driver over a bounded sample of
labelled documents (``Boosting.rows``); scoring streams over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.stats import COUNTS, stream
from tessera.llm.training import held_out, sample


@dataclass(frozen=True)
class Boosting:
    """Most labelled rows, trees, depth, bins, learning rate, leaf penalty, least second-derivative sum of a leaf."""

    rows: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    penalty: float = 1.0
    least: float = 3.0


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios and sizes of each document, a row each."""
    words, chars, letters, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "n_chars", "n_letters", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_symbol_words"] / words, c["n_upper"] / letters,
            c["n_digits"] / chars, c["n_marks"] / words, c["n_punct"] / words, c["n_letters"] / chars, words / lines, c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words, c["n_distinct_words"] / words, c["n_top_word"] / words, c["n_same_next"] / words,
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Trees as arrays: ``feature`` and ``cut`` by tree and inner node in heap order, ``value`` by tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, (trees, inner) = len(x), self.feature.shape
        node = np.zeros((n, trees), np.int64)
        rows, t = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
        raw = self.base + self.value[t, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, p: Boosting) -> Forest:
    """Boosts on the logistic loss. Without rows of both labels the forest says the share of label 1 (0.5 without rows)."""
    inner, leaves = 2**p.depth - 1, 2**p.depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, cut, value = np.zeros((p.trees, inner), np.int64), np.full((p.trees, inner), np.inf), np.zeros((p.trees, leaves))
    if not 0 < y.sum() < len(y):
        return Forest(base, feature, cut, value)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # x <= edge k goes to bin k at most
    raw = np.full(n, base)
    for t in range(p.trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(p.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = node - first
            for j in range(m):
                flat = local * p.bins + binned[:, j]
                gl, hl = (np.bincount(flat, w, width * p.bins).reshape(width, p.bins).cumsum(1) for w in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + p.penalty) + (gt - gl) ** 2 / (ht - hl + p.penalty) - gt**2 / (ht + p.penalty)
                gain[(hl < p.least) | (ht - hl < p.least)] = 0
                k = gain[:, : len(edges[j])].argmax(1) if len(edges[j]) else np.zeros(width, int)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best) if len(edges[j]) else ():
                    best[w], feature[t, first + w], cut[t, first + w] = top[w], j, edges[j][k[w]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        step = -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + p.penalty)
        value[t] = p.rate * step
        raw += value[t][leaf]
    return Forest(base, feature, cut, value)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, c in stream(b.column(1)):
            n = len(c["n_words"])
            yield pa.RecordBatch.from_arrays([b.column(2).slice(first, n), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], ["label", *COUNTS])


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, c in stream(b.column(1)):
                p = forest.score(features(c))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(p)), pa.array(p)], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, hold: int = 0, p: Boosting = Boosting()) -> Forest:
    """A forest from labelled documents outside the held-out fold; only counts of at most ``p.rows`` texts reach the driver."""
    rows = sample(docs, labels, "quality", folds, hold, p.rows)
    got = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_measure, "label int, " + ", ".join(f"{k} long" for k in COUNTS)).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")  # the sums of floats then don't depend on task order
    return fit(features({k: got[k].to_numpy() for k in COUNTS}), got["label"].to_numpy(float), p)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, hold: int = 0, threshold: float = 0.3, p: Boosting = Boosting()) -> DataFrame:
    """Scores each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if
    score >= ``threshold``). Null text counts as empty and is scored as such. Rows
    repeated or without doc_id are scored like any other; without doc_id held_out is
    false. An empty table gives an empty result; without labels every score is 0.5.
    """
    forest = train(docs, labels, folds, hold, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(forest), "doc_id long, score double")
    return out.select("doc_id", held_out(folds, hold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
