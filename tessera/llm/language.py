"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are all runs of 1 to ``longest`` bytes of the lower-cased text in which
everything but letters is one kind of gap, and whole words; each falls in one of
``2 ** bits`` buckets. A document is the mean of its subwords' embeddings. Embeddings and the softmax
are trained together by stochastic gradient descent in numpy, on a bounded sample
of labelled documents (``Language.rows``). As both layers are linear, scoring needs
only their product: one small vector of class scores a bucket.

Part of the sample is kept from training to calibrate: a temperature is chosen by
likelihood, and a document is rejected if its confidence lies below a bound under
which at most ``spare`` of the rightly predicted calibration documents fall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.stats import ALPHA
from tessera.llm.textlib import LANE, Slice, parts, slices
from tessera.llm.training import held_out, sample

GAP = ~ALPHA
UNKNOWN = "und"
#: Bytes worked through at a time: a byte takes some hundred in subwords and their scores.
PIECE = 1 << 18


@dataclass(frozen=True)
class Language:
    """Most labelled rows, bits of a bucket, longest subword in bytes, embedding width, batch, passes, rate, part kept for calibration, label smoothing there, spared part, highest bound."""

    rows: int = 1_500
    bits: int = 14
    longest: int = 4
    width: int = 16
    batch: int = 4
    passes: int = 3
    rate: float = 0.5
    calibrate: float = 0.2
    smooth: float = 0.02
    spare: float = 0.001
    ceiling: float = 0.5


def subwords(s: Slice, p: Language) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, pointer by row) for each length of subword, and for whole words."""
    starts, ends, ptr = s.words(GAP)
    yield (LANE.words(s.buf, starts, ends) >> np.uint64(64 - p.bits)).astype(np.int64), ptr
    b = np.where(GAP[s.buf], 32, s.buf).astype(np.uint64)
    edge = s.offs
    for n in range(1, p.longest + 1):
        size = max(0, len(b) - n + 1)
        code = np.full(size, n, np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + b[j : j + size]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - p.bits)
        keep = b[:size] != 32 if n == 1 else ~((b[:size] == 32) & (b[1 : size + 1] == 32))
        for k in range(1, n):  # runs that would cross into the next row
            at = edge[1:] - k
            keep[at[(at >= edge[:-1]) & (at < size)]] = False
        at = np.flatnonzero(keep)
        yield code[at].astype(np.int64), np.searchsorted(at, edge)


@dataclass
class Model:
    """Class names, class scores of each bucket, temperature and least confidence."""

    names: list[str]
    table: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0

    def raw(self, s: Slice, p: Language) -> np.ndarray:
        total, count = np.zeros((len(s), len(self.names))), np.zeros(len(s))
        for bucket, ptr in subwords(s, p):
            n = np.diff(ptr)
            some = np.flatnonzero(n)
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], ptr[some], axis=0)
            count += n
        return total / np.maximum(count, 1)[:, None]

    def confidence(self, raw: np.ndarray) -> np.ndarray:
        x = raw / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


class _Means:
    """Share of each of a document's buckets, worked out when asked for: the counts stay as they came."""

    def __init__(self, docs):
        self.docs = docs

    def __getitem__(self, k: int) -> np.ndarray:
        c = self.docs[k][1]
        return c / max(int(c.sum()), 1)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], p: Language) -> Model:
    """SGD over documents given as (distinct buckets, counts); no labelled document gives a model that knows no language."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((2**p.bits, 0)))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(10)
    order = rng.permutation(len(y))
    held = order[: int(len(y) * p.calibrate)]
    train = order[len(held) :]
    embed, soft = rng.normal(0, 0.1, (2**p.bits, p.width)), np.zeros((p.width, len(names)))
    mean = _Means(docs)
    for step in range(p.passes):
        rate = p.rate * (1 - step / p.passes)
        for i in range(0, len(train), p.batch):
            at = train[i : i + p.batch]
            bucket, weight = np.concatenate([docs[k][0] for k in at]), np.concatenate([mean[k] for k in at])
            ptr = np.cumsum([0, *(len(docs[k][0]) for k in at)])
            full = np.flatnonzero(np.diff(ptr))
            hidden = np.zeros((len(at), p.width))
            if len(full):
                hidden[full] = np.add.reduceat(embed[bucket] * weight[:, None], ptr[:-1][full], axis=0)
            raw = hidden @ soft
            prob = np.exp(raw - raw.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(at)), y[at]] -= 1
            back = np.repeat(prob @ soft.T, np.diff(ptr), axis=0) * weight[:, None]
            soft -= rate * hidden.T @ prob
            np.subtract.at(embed, bucket, rate * back)
    model = Model(names, embed @ soft)
    if len(held):
        raw = np.stack([mean[k] @ model.table[docs[k][0]] if len(docs[k][0]) else np.zeros(len(names)) for k in held])
        loss = {}
        for t in np.geomspace(0.02, 5, 40):
            model.temperature = t
            logs = np.log(np.maximum(model.confidence(raw), 1e-12))
            loss[t] = -((1 - p.smooth) * logs[np.arange(len(held)), y[held]] + p.smooth * logs.mean(1)).mean()
        model.temperature = float(min(loss, key=loss.get))
        sure = model.confidence(raw)
        right = sure.max(1)[sure.argmax(1) == y[held]]
        model.bound = float(min(p.ceiling, np.quantile(right, p.spare))) if len(right) else 0.0
    return model


def _text(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _extract(p: Language):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for s in slices(_text(b.column(1)), PIECE):
                found = list(subwords(s, p))
                keys = [np.unique(np.concatenate([k[ptr[i] : ptr[i + 1]] for k, ptr in found]), return_counts=True) for i in range(len(s))]
                col = lambda j, t: pa.array([k[j].astype(t).tobytes() for k in keys], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), b.column(2).slice(s.first, len(s)), col(0, np.uint32), col(1, np.uint32)], ["doc_id", "label", "buckets", "counts"])

    return run


def _predict(m: Model, p: Language, names: list[str]):
    """Language and score of the texts in the second column, beside the columns in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for s in slices(_text(b.column(1)), PIECE):
                n = len(s)
                if m.names:
                    sure = m.confidence(m.raw(s, p))
                    lang, score = [m.names[k] for k in sure.argmax(1)], sure.max(1)
                else:
                    lang, score = [UNKNOWN] * n, np.zeros(n)
                same = [b.column(k).slice(s.first, n) for k, name in enumerate(b.schema.names) if name in names]
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), *same], names)

    return run


def train(docs: DataFrame, folds: int = 4, hold: int = 2, p: Language = Language()) -> Model:
    """A model from documents with a language outside the held-out fold; bucket counts of at most ``p.rows`` texts reach the driver."""
    rows = sample(docs, docs, "lang", folds, hold, p.rows)
    got = rows.select("doc_id", "text", F.col("label").cast("string").alias("label")).mapInArrow(_extract(p), "doc_id long, label string, buckets binary, counts binary").toPandas().sort_values("doc_id")
    return fit([(np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32)) for k, c in zip(got["buckets"], got["counts"])], list(got["label"]), p)


def identify(docs: DataFrame, folds: int = 4, hold: int = 2, p: Language = Language(), model: Model | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Predicts the language of each row of ``docs`` (doc_id, text, and lang to learn from; other columns are ignored).

    Returns doc_id, held_out, lang_pred (a learned language; ``und`` if the text is null
    or has no letter, or nothing was learned), score (calibrated confidence, 0 for
    ``und``), rejected (``und``, or confidence below the calibrated bound), and the columns
    ``keep`` of ``docs``, each verdict beside its own row. Rows repeated
    or without doc_id are predicted like any other; without doc_id held_out is false. An
    empty table gives an empty result.
    """
    model = model or train(docs, folds, hold, p)
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    # A text that is kept goes to Python once: a batch holds up to 10,000 of them on both sides.
    judged = "kept_text" if "text" in keep and docs.schema["text"].dataType == T.StringType() else "judged"
    rest = [c for c in keep if f"kept_{c}" != judged]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias(judged), lettered.alias("lettered"), *(F.col(c).alias(f"kept_{c}") for c in rest))
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(f for f in rows.schema if f.name != "judged")])
    out = rows.mapInArrow(_predict(model, p, schema.names), schema)
    known = F.col("lettered") & (F.col("lang_pred") != UNKNOWN)
    score = F.when(known, F.col("score")).otherwise(0.0)
    return out.select("doc_id", held_out(folds, hold).alias("held_out"), F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"), (~known | (score < model.bound)).alias("rejected"), *(F.col(f"kept_{c}").alias(c) for c in keep))
