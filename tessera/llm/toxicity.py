"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the buckets its words, pairs of neighbours and pairs with
``skips`` words between them fall in, each present or not. Every coordinate has its own
learning rate, and the L1 term leaves most weights at exactly zero: only the others,
as sorted (bucket, weight) arrays, go to the executors. Training is one sequential
pass after another over a bounded sample of labelled documents (``Ftrl.rows``).

No feature is left out for being rare. While a weight is zero, each document that has
the bucket moves its sum by less than 1 a pass, so a bucket of ``n`` documents can leave
zero only if ``n * passes > l1``; the others (``Ftrl.least``) are never sent to the driver.

L1 keeps scores near the middle. A line through the raw scores of documents kept from a
first fit, found by likelihood, stretches and shifts those of the final one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.stats import ALPHA, DIGIT
from tessera.llm.textlib import LANE, LOWER, U64, Slice, mix, room, slices
from tessera.llm.training import held_out, sample

OTHER = ~(ALPHA | DIGIT)


@dataclass(frozen=True)
class Ftrl:
    """Most labelled rows, bits of a bucket, words skipped, passes, rate (alpha, beta), penalties (l1, l2), part kept for calibration, fewest documents of a label there."""

    rows: int = 12_000
    bits: int = 24
    skips: tuple[int, ...] = (1, 2)
    passes: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    calibrate: float = 0.2
    enough: int = 10

    @property
    def least(self) -> int:
        """The fewest documents whose bucket can get a weight."""
        return int(self.l1 // self.passes) + 1


def buckets(s: Slice, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, pair and skip pair of a slice; words are runs of letters and digits, A-Z lower-cased."""
    s.buf = LOWER[s.buf]
    starts, ends, ptr = s.words(OTHER)
    words, left = LANE.words(s.buf, starts, ends), room(ptr)
    rows = np.repeat(np.arange(len(s)), np.diff(ptr))
    row, key = [rows], [words]
    for gap in (1, *(k + 1 for k in p.skips)):
        ok = np.flatnonzero(left > gap)
        row.append(rows[ok])
        key.append(mix(words[ok] * U64(2 * gap + 1) + words[ok + gap] * U64(0x9E3779B97F4A7C15)))
    return np.concatenate(row), (np.concatenate(key) >> U64(64 - p.bits)).astype(np.int64)


@dataclass
class Weights:
    """Bias and the weights that are not zero, by ascending bucket."""

    bias: float
    bucket: np.ndarray
    weight: np.ndarray

    @cached_property
    def near(self) -> np.ndarray:
        """Whether any bucket with a weight has the same lower 20 bits: a small table to look in first."""
        out = np.zeros(2**20, bool)
        out[self.bucket & (2**20 - 1)] = True
        return out

    def score(self, n: int, row: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
        raw = np.full(n, self.bias)
        if len(self.bucket):
            hit = np.flatnonzero(self.near[key & (2**20 - 1)])
            hit = hit[np.isin(key[hit], self.bucket)]
            pair = np.unique(row[hit] << bits | key[hit])
            np.add.at(raw, pair >> bits, self.weight[np.searchsorted(self.bucket, pair & (2**bits - 1))])
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def fit(docs: list[np.ndarray], y: np.ndarray, p: Ftrl, size: int | None = None) -> Weights:
    """FTRL-proximal over documents given as arrays of distinct buckets, below ``size``; an empty sample gives a score of 0 < s < 0.3 for all."""
    if not len(y):
        return Weights(-2.0, np.zeros(0, np.int64), np.zeros(0))
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    size = 2**p.bits if size is None else size
    z, n = np.zeros(size), np.zeros(size)
    zb, nb = 0.0, 0.0
    order = np.random.default_rng(2).permutation(len(y))
    shown = bias
    for _ in range(p.passes):
        for i in order:
            at = docs[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            shown = bias - zb / ((p.beta + np.sqrt(nb)) / p.alpha + p.l2)
            prob = 1 / (1 + np.exp(-np.clip(w.sum() + shown, -35, 35)))
            g = prob - y[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * (shown - bias)
            nb += g * g
    w = np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    keep = np.flatnonzero(w)
    return Weights(float(shown), keep, w[keep])


def line(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over raw scores, by Newton's method, with a faint pull of the slope to 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
        w = prob * (1 - prob)
        slope = np.array([((prob - y) * raw).sum() + 1e-3 * (a - 1), (prob - y).sum()])
        bend = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.1), b


def calibrated(docs: list[np.ndarray], y: np.ndarray, p: Ftrl, size: int) -> Weights:
    """``fit`` with the line that suits documents it hasn't seen; as it is where too few can be spared."""
    order = np.random.default_rng(4).permutation(len(y))
    held, rest = order[: int(len(y) * p.calibrate)], order[int(len(y) * p.calibrate) :]
    a, b = 1.0, 0.0
    if min(y[held].sum(), (1 - y[held]).sum()) >= p.enough:
        first = fit([docs[i] for i in rest], y[rest], p, size)
        table = np.zeros(size)
        table[first.bucket] = first.weight
        a, b = line(np.array([first.bias + table[docs[i]].sum() for i in held]), y[held])
    w = fit(docs, y, p, size)
    return Weights(a * w.bias + b, w.bucket, a * w.weight)


def _present(s: Slice, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct bucket of a row, in order."""
    row, key = buckets(s, p)
    pair = np.unique(row << p.bits | key)
    return pair >> p.bits, pair & (2**p.bits - 1)


def _count(p: Ftrl):
    """In how many documents of a slice each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                at, n = np.unique(_present(s, p)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["bucket", "n"])

    return run


def _extract(p: Ftrl, common: np.ndarray):
    """Each document's buckets among ``common``, as places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                row, key = _present(s, p)
                at = np.searchsorted(common, key)
                hit = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == key) if len(common) else np.zeros(0, np.int64)
                row, key = row[hit], at[hit].astype(np.uint32)
                ptr = np.searchsorted(row, np.arange(len(s) + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), b.column(2).slice(s.first, len(s)), pa.array([key[i:j].tobytes() for i, j in zip(ptr, ptr[1:])], pa.binary())], ["doc_id", "label", "buckets"])

    return run


def _score(w: Weights, p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), pa.array(w.score(len(s), *buckets(s, p), p.bits))], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, hold: int = 2, p: Ftrl = Ftrl()) -> Weights:
    """Weights from labelled documents outside the held-out fold.

    Buckets that can get a weight, of at most ``p.rows`` texts, reach the driver.
    """
    rows = sample(docs, labels, "toxic", folds, hold, p.rows).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    common = rows.mapInArrow(_count(p), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least).select("bucket").toPandas()["bucket"].to_numpy()
    common = np.sort(common)
    got = rows.mapInArrow(_extract(p, common), "doc_id long, label int, buckets binary").toLocalIterator()  # a partition at a time
    got = sorted(((r[0], r[1], np.frombuffer(r[2], np.uint32)) for r in got), key=lambda r: r[0])
    w = calibrated([r[2] for r in got], np.array([r[1] for r in got], float), p, len(common))
    return Weights(w.bias, common[w.bucket], w.weight)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, hold: int = 2, threshold: float = 0.3, p: Ftrl = Ftrl()) -> DataFrame:
    """Scores each row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if
    score >= ``threshold``). Null and empty texts have no features and get the bias's
    score. Rows repeated or without doc_id are scored like any other; without doc_id
    held_out is false. An empty table gives an empty result.
    """
    w = train(docs, labels, folds, hold, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(w, p), "doc_id long, score double")
    return out.select("doc_id", held_out(folds, hold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
