"""Vector functions on arrays of numbers, computed in double precision."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts whose words are held at once.
TEXTS = 256


def fit_dims(v: Column, n: int = 1024) -> Column:
    """``v`` cut or padded with zeros to ``n`` values."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors of one length."""
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for null or empty vectors, different lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok & (norm > 0), dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(-1.0)


def hashing_embedding(text: Column, n: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: counts of words by hash, as ``n`` floats. Runs over Arrow batches, as a model would."""

    def part(texts: pd.Series) -> list[np.ndarray]:
        words = texts.fillna("").str.lower().str.findall(r"\w+")
        flat = words.explode().dropna()
        known = {w: zlib.crc32(w.encode()) % n for w in flat.unique()}
        row = np.repeat(np.arange(len(words)), words.str.len().to_numpy())
        counts = np.bincount(row * n + flat.map(known).to_numpy(np.int64), minlength=len(words) * n).reshape(-1, n)
        return list(counts.astype(np.float32))

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([v for i in range(0, len(texts), TEXTS) for v in part(texts.iloc[i : i + TEXTS])])

    return embed(text)
