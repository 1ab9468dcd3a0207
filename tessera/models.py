"""Plug-in points for external models, with deterministic stand-ins, and a registry of named table functions.

A model object is built once for each partition and fed Arrow batches; a failed call gives a
null answer and an error text, never a failed job.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class EmbeddingModel(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class RerankModel(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


class TextModel(Protocol):
    """OCR, transcription or language model: one text for each input."""

    def answer(self, inputs: Sequence) -> Sequence[str]: ...


class LengthReranker:
    """Stand-in: prefers the text whose length is nearest the query's."""

    def score(self, query: str, texts: Sequence[str]) -> Sequence[float]:
        return [-abs(len(t) - len(query)) for t in texts]


class EchoModel:
    """Stand-in: the first 80 characters of its input."""

    def answer(self, inputs: Sequence) -> Sequence[str]:
        return [str(x)[:80] for x in inputs]


def apply_text(df: DataFrame, make: Callable[[], TextModel], column: str = "input") -> DataFrame:
    """Rows (id, answer, error) of a text model over column ``column``; a failing batch is tried again row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            values = list(b[column])
            try:
                out = [(a, None) for a in model.answer(values)]
            except Exception:  # noqa: BLE001
                out = []
                for v in values:
                    try:
                        out.append((model.answer([v])[0], None))
                    except Exception as e:  # noqa: BLE001  the row carries its error
                        out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame({"id": b["id"], "answer": [a for a, _ in out], "error": [e for _, e in out]})

    return df.select("id", column).mapInPandas(run, "id long, answer string, error string")


def apply_embedding(df: DataFrame, make: Callable[[], EmbeddingModel]) -> DataFrame:
    """Rows (id, embedding) of an embedding model over column ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": [list(map(float, v)) for v in model.embed([t or "" for t in b["text"]])]})

    return df.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def rerank(candidates: DataFrame, make: Callable[[], RerankModel], query: str, top_k: int) -> DataFrame:
    """Candidates (rank, content, ...) by model score, ties in candidate order; without more than ``top_k`` of them the order stands. They are a top-k result."""
    if candidates.limit(top_k + 1).count() <= top_k:
        return candidates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(score=[float(x) for x in model.score(query, [t[:2000] for t in b["content"]])])

    fields = ", ".join(f"{n} {t}" for n, t in candidates.dtypes)
    from pyspark.sql import functions as F

    return candidates.mapInPandas(run, fields + ", score double").orderBy(F.desc("score"), "rank").limit(top_k)


#: Types a table function's arguments may have.
KINDS = {str: "string", int: "integer", bool: "boolean", float: "number", list: "array"}


class Tools:
    """Named table functions with a schema taken from their annotations; a bad call is an error value, not an exception."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def add(self, f: Callable) -> Callable:
        if f.__name__ in self.functions:
            raise ValueError(f"{f.__name__} is there already")
        self.functions[f.__name__] = f
        return f

    def schema(self, name: str) -> dict:
        f = self.functions[name]
        fields = {k: p for k, p in inspect.signature(f, eval_str=True).parameters.items() if k != "spark"}
        bad = [k for k, p in fields.items() if p.annotation not in KINDS]
        if bad:
            raise TypeError(f"{name}: no type for {bad}")
        return {"name": name, "description": inspect.getdoc(f) or "", "properties": {k: KINDS[p.annotation] for k, p in fields.items()}, "required": [k for k, p in fields.items() if p.default is p.empty]}

    def call(self, spark, name: str, **arguments) -> tuple[DataFrame | None, str | None]:
        if name not in self.functions:
            return None, f"no tool {name}"
        schema = self.schema(name)
        if missing := [k for k in schema["required"] if k not in arguments]:
            return None, f"missing {', '.join(missing)}"
        if unknown := [k for k in arguments if k not in schema["properties"]]:
            return None, f"unknown {', '.join(unknown)}"
        try:
            return self.functions[name](spark, **arguments), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"[:200]
