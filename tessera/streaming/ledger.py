"""Tables that grow by batches, each taken in once however often it is replayed, and vectors kept by the text they belong to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.chunking import OVERLAP, SIZE, chunk


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system: the ledger lies where the tables do, whatever store that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class Ledger:
    """Tables below ``folder``, written batch by batch; a batch counts once its mark is there.

    A batch's rows go to a folder of its own, which a second attempt replaces. The mark is made
    after all its tables, by a rename, so a reader sees all of a batch or nothing, and a batch whose writer died
    before the stream noted it is known when it comes again.
    """

    spark: SparkSession
    folder: str

    def done(self, batch: int) -> bool:
        at, fs = _path(self.spark, f"{self.folder}/_ledger/batch-{batch}")
        return fs.exists(at)

    def batches(self) -> list[int]:
        at, fs = _path(self.spark, f"{self.folder}/_ledger")
        return sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("batch-")) if fs.exists(at) else []

    def take(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Writes the batch's tables, if it isn't there yet; whether it was new."""
        if self.done(batch):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/batch={batch}")
        begun, fs = _path(self.spark, f"{self.folder}/_ledger/_begun-{batch}")
        fs.create(begun, True).close()
        fs.rename(begun, _path(self.spark, f"{self.folder}/_ledger/batch-{batch}")[0])
        return True

    def read(self, name: str, schema: str) -> DataFrame:
        """A table's rows of all batches that count."""
        parts = [f"{self.folder}/{name}/batch={b}" for b in self.batches()]
        there = [p for p in parts if _path(self.spark, p)[1].exists(_path(self.spark, p)[0])]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)


class TooLong(ValueError):
    """A model's answer to a text beyond its context; ``limit`` is the most characters it says it takes, if it does."""

    def __init__(self, limit: int | None = None) -> None:
        super().__init__("text beyond the model's context")
        self.limit = limit


#: A text is cut to this share of its length, but not below the least, so many times (fixed values).
CUT, LEAST, ATTEMPTS = 0.8, 128, 6
#: What a vector is for (fixed values).
INPUT_TYPES = ("search_document", "search_query", "classification", "clustering")


def embedded(model, texts: Sequence[str]) -> list[list[float] | None]:
    """Vectors of a batch of texts. If one is too long each is asked alone, and cut until it fits; what never fits has no vector."""
    try:
        return [list(map(float, v)) for v in model.embed(texts)]
    except TooLong:
        return [_alone(model, t) for t in texts]


def _alone(model, text: str) -> list[float] | None:
    for _ in range(ATTEMPTS):
        try:
            return list(map(float, model.embed([text])[0]))
        except TooLong as e:
            length = max(LEAST, e.limit) if e.limit and len(text) > max(LEAST, e.limit) else max(LEAST, int(len(text) * CUT))
            if length >= len(text):
                return None
            text = text[:length]
    return None


def embed(rows: DataFrame, make: Callable[[], object], input_type: str = "search_query") -> DataFrame:
    """``rows`` (with ``text``) with ``embedding``, of a model made once a task; null where the text is null or never fits."""
    if input_type not in INPUT_TYPES:
        raise ValueError(f"bad input type: {input_type}")

    def run(batches):
        model = make()
        for b in batches:
            known = b["text"].notna()
            vectors = iter(embedded(model, list(b["text"][known]))) if known.any() else iter(())
            yield b.assign(embedding=pd.Series([next(vectors) if k else None for k in known], index=b.index, dtype=object))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def with_images(rows: DataFrame, make: Callable[[], object], multimodal: Callable[[], object] | None = None) -> DataFrame:
    """Vectors of captions with images (``text``, ``image``): of the multimodal model where there is one and it answers, else of the caption alone."""
    if multimodal is None:
        return embed(rows, make, "search_document")

    def run(batches):
        model, both = make(), multimodal()
        for b in batches:
            out = []
            for text, image in zip(b["text"], b["image"], strict=True):
                try:
                    vector = list(map(float, both.embed_image(text, image))) if image is not None else None
                except Exception:  # noqa: BLE001  the caption stands in for any failure
                    vector = None
                out.append(vector or (embedded(model, [text])[0] if text is not None else None))
            yield b.assign(embedding=pd.Series(out, index=b.index, dtype=object))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


VECTORS = "text_hash string, embedding array<float>"


def new_vectors(texts: DataFrame, known: DataFrame, make: Callable[[], object]) -> DataFrame:
    """Vectors (text_hash, embedding) of the distinct texts whose hash isn't known yet; null and empty texts have none."""
    keyed = texts.where("text IS NOT NULL AND text <> ''").select(F.sha2("text", 256).alias("text_hash"), "text")
    distinct = keyed.groupBy("text_hash").agg(F.first("text").alias("text"))
    return embed(distinct.join(known.select("text_hash"), "text_hash", "left_anti"), make, "search_document").drop("text")


DOCUMENTS = "doc_id string, text string"
CHUNKS = "doc_id string, chunk_number int, start_position int, end_position int, content string, text_hash string"


def ingest(ledger: Ledger, parse: Callable[[DataFrame], DataFrame], make: Callable[[], object], size: int = SIZE, overlap: int = OVERLAP) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch``: arrived files -> ``parse`` (doc_id, text) -> chunks -> vectors.

    Tables documents, chunks and vectors; a document that comes again keeps its first text.
    Each distinct chunk text is embedded once over all batches, whatever documents hold it. A replayed batch changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        if ledger.done(number):
            return
        docs = parse(batch).select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = docs.join(ledger.read("documents", DOCUMENTS).select("doc_id"), "doc_id", "left_anti")
        docs = docs.persist()
        cut = chunk(docs, size, overlap).withColumn("text_hash", F.sha2("content", 256))
        vectors = new_vectors(cut.select(F.col("content").alias("text")), ledger.read("vectors", VECTORS), make)
        ledger.take(number, {"documents": docs, "chunks": cut.select(*(c.split()[0] for c in CHUNKS.split(", "))), "vectors": vectors})
        docs.unpersist()

    return step


def with_vectors(ledger: Ledger) -> DataFrame:
    """All chunks with the vector of their text."""
    return ledger.read("chunks", CHUNKS).join(ledger.read("vectors", VECTORS), "text_hash", "left")
