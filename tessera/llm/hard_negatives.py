"""Hard negatives: rows of another label that score just below an anchor's positives, by full sorts of integer scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.vectorlib import integers, products, usable

#: Rows and anchors of a block. A task holds two blocks and the scores of ``BAND`` anchors with one of them.
BLOCK, ANCHORS, BAND = 4096, 512, 32
PACKED = "width int, ids binary, labels binary, points binary, known array<array<array<long>>>"
SCORED = "anchor_id long, place int, positive_id long, positive_score long, row_id long, score long"


@dataclass(frozen=True)
class Mining:
    """Anchors are the ids divisible by ``every``; so many positives of each and negatives of each positive; negatives reach from a positive's score down to ``percent`` of it."""

    every: int = 100
    positives: int = 5
    negatives: int = 5
    percent: int = 80


def _packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, label, v, known) of a partition in blocks of one width, ordered by id."""

    def block(rows: pd.DataFrame, width: int) -> pa.RecordBatch:
        rows = rows.sort_values("vec_id", kind="stable")
        points = integers(pa.array(rows["v"].tolist(), pa.list_(pa.float64()))).astype(np.int32)
        ids, labels = (rows[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([ids]), pa.array([labels]), pa.array([points.tobytes()]), pa.array([[[list(y) for y in x] for x in rows["known"]]], pa.list_(pa.list_(pa.list_(pa.int64()))))],
            ["width", "ids", "labels", "points", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pd.DataFrame] = {}
        for b in batches:
            rows = b.to_pandas()
            for width, part in rows.groupby(rows["v"].map(len)):
                part = pd.concat([held.pop(width), part]) if width in held else part
                while len(part) >= size:
                    yield block(part[:size], width)
                    part = part[size:]
                held[width] = part
        for width, part in held.items():
            if len(part):
                yield block(part, width)

    return run


def _blocks(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "points"], np.int32).reshape(len(ids), -1).astype(np.int64)


def _sorted(row: dict) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a pair of blocks: its place, id and label, then ids, labels and scores of all rows of another id, greatest score first, then smallest id."""
    ids, labels, points = _blocks(row)
    own, named, anchors = _blocks(row, "a_")
    for i in range(0, len(own), BAND):
        scores = products(anchors[i : i + BAND], points)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)
        for j, at in enumerate(order, i):
            at = at[ids[at] != own[j]]
            yield j, own[j], named[j], ids[at], labels[at], scores[j - i, at]


def _positives(row: dict, by: Mining) -> Iterator[tuple]:
    """An anchor's first rows of its label."""
    for _, anchor, label, ids, labels, scores in _sorted(row):
        for at in np.flatnonzero(labels == label)[: by.positives]:
            yield anchor, 0, ids[at], scores[at], ids[at], scores[at]


def _negatives(row: dict, by: Mining) -> Iterator[tuple]:
    """For each of an anchor's positives, the first rows of other labels from its score down to the lower limit."""
    for j, anchor, label, ids, labels, scores in _sorted(row):
        other = np.flatnonzero(labels != label)
        down = -scores[other]
        for place, positive, limit in row["a_known"][j]:
            start = np.searchsorted(down, -limit)
            for at in other[start : start + by.negatives]:
                if by.percent * limit <= 100 * int(scores[at]):
                    yield anchor, place, positive, limit, ids[at], scores[at]


def _scored(rows: DataFrame, anchors: DataFrame, found: Callable[[dict, Mining], Iterator[tuple]], by: Mining) -> DataFrame:
    """What ``found`` takes from each pair of a block of rows and one of anchors of its width. A task meets a partition of blocks with one of anchors; none pass through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        for b in batches:
            for i in range(b.num_rows):
                for row in b.slice(i, 1).to_pylist():
                    got = list(zip(*found(row, by), strict=True))
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(x), k) for x, k in zip(got, kinds, strict=True)], ["anchor_id", "place", "positive_id", "positive_score", "row_id", "score"])

    met = anchors.select("width", *(F.col(c).alias("a_" + c) for c in ("ids", "labels", "points", "known"))).hint("shuffle_replicate_nl")
    return rows.drop("known").join(met, "width").drop("width").mapInArrow(run, SCORED)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of an anchor and place by score, then id."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, by: Mining = Mining(), label: Column | None = None) -> DataFrame:
    """Hard negatives of every anchor and positive among ``rows`` (vec_id, embedding, label; other columns are ignored).

    ``label`` replaces a row's label. Rows without vec_id or label, and vectors that are
    null, empty or have null or non-finite components (or ones beyond 2**27 once integer) take no
    part. Where several rows share an anchor's id, the one of least label, then vector, is the
    anchor. Vectors of another length than the anchor's don't meet it. An anchor's others are the
    rows of any other id, repeated ones as often as they occur.

    Rows and anchors meet in blocks. In each pair of blocks an anchor's scores are sorted in
    full; its first positives, and then, once these are known over all blocks, the first negatives
    below each one's limit are cut from the sorted run by binary search. Only what is cut is merged over
    blocks, and a hot label or vector makes no larger group. A task meets the blocks of two parts of
    written files, pair by pair; nothing is broadcast, so the driver holds no anchors whatever the table
    and its statistics. Work grows with anchors times rows, as the search asks.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. An
    empty table, or one without anchors, gives an empty result.
    """
    named = (F.col("label") if label is None else label).cast("long").alias("label")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), named, F.col("embedding").cast("array<double>").alias("v"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("known", F.array().cast("array<array<long>>"))
    anchors = base.where(F.col("vec_id") % by.every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    anchors = written(anchors, "anchors")
    parts = -(-anchors.count() // ANCHORS) or 1
    blocks = written(base.mapInArrow(_packed(BLOCK), PACKED), "blocks")

    def packed(frame: DataFrame) -> DataFrame:
        return written(frame.select("vec_id", "label", "v", "known").repartition(parts, "vec_id").mapInArrow(_packed(ANCHORS), PACKED), "packed")

    near = _first(_scored(blocks, packed(anchors.withColumn("known", F.array().cast("array<array<long>>"))), _positives, by), by.positives)
    known = near.groupBy("anchor_id").agg(F.collect_list(F.array(F.col("rank").cast("long"), "positive_id", "positive_score")).alias("known"))
    anchors = written(anchors.join(known.hint("merge"), anchors["vec_id"] == known["anchor_id"]), "known")
    return _first(_scored(blocks, packed(anchors), _negatives, by), by.negatives).select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
