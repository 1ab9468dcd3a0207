"""A persisted index of vectors in cells with radii; searches skip cells by the triangle inequality and stay exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import written

#: Most cells, so many rows of a bounded sample a cell, and rounds in which the sample places them.
CELLS, SAMPLE, ROUNDS = 1024, 8, 4
#: Vectors and query vectors of a block: a task holds one of each.
BLOCK, QUERIES = 2048, 1024
#: Rows of queries for shelves that a task makes at a time.
SENT = 4096
#: Shelves of pools, and bands of query blocks, as long as none holds more than so many vectors: every query goes to each shelf at most once, every block to each band once.
SHELVES, BANDS, HELD = 8, 8, 65_536
#: Room for rounding in bounds on distances.
SLACK = 1e-6

PACKED = "pool int, ids binary, cells binary, points binary"
FOUND = "q long, id long, distance double, scored long"


def usable(vectors: DataFrame, width: int) -> DataFrame:
    """Rows of ``vectors`` (id, vector) of that length without null or non-finite components."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where((F.size("vector") == width) & F.col("id").isNotNull() & F.coalesce(F.forall("vector", lambda x: F.abs(x) < 1e150), F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of floats."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, by differences: near pairs lose no digits."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        apart_ = b - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", apart_, apart_))
    return out


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of a few rounds over a bounded sample, which only decide how well cells prune, never what is found."""
    middle = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        near = ((sample * sample).sum(1)[:, None] + (middle * middle).sum(1)[None] - 2 * sample @ middle.T).argmin(1)
        for c in np.unique(near):
            middle[c] = sample[near == c].mean(0)
    return middle


def pooled(count: np.ndarray) -> np.ndarray:
    """The pool of each cell: neighbours by number share one as long as it holds at most ``BLOCK``."""
    pool, held, out = 0, 0, np.zeros(len(count), np.int64)
    for c, n in enumerate(count):
        if held and held + n > BLOCK:
            pool, held = pool + 1, 0
        out[c], held = pool, held + n
    return out


def shelved(held: np.ndarray) -> np.ndarray:
    """The shelf of each pool: neighbours by number share one, about ``SHELVES`` in all, or more where these would hold more than ``HELD``."""
    before = np.cumsum(held) - held
    return (before // max(BLOCK, min(HELD, -(-int(held.sum()) // SHELVES)))).astype(np.int64)


@dataclass(frozen=True)
class VectorIndex:
    """``blocks`` of packed vectors with their shelf, and for every cell its centre, radius, number of vectors and the shelf it is on."""

    blocks: DataFrame
    middle: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    shelf: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, width: int, cells: int | None = None) -> VectorIndex:
        """Indexes every row of ``vectors`` (id, vector) with ``width`` finite components; others can't be found.

        Cells are placed on a bounded sample (``SAMPLE`` rows for each of at most ``CELLS``, those of
        least hash of their id), then every vector joins its nearest one. Small cells share a
        pool, which is one block of at most about ``BLOCK`` vectors; a cell that holds more is a pool of several blocks by
        hash of the id. One row a cell reaches the driver.
        """
        rows = usable(vectors, width)
        cells = cells or int(min(CELLS, max(1, rows.count() ** 0.5)))
        drawn = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE * cells).select("vector").toArrow()
        middle = centres(matrix(drawn.column(0).combine_chunks()), cells) if drawn.num_rows else np.zeros((0, width))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    away = apart(matrix(b.column("vector")), middle)
                    near = away.argmin(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], [*b.schema.names, "cell", "away"])

        placed = written(rows.mapInArrow(place, "id long, vector array<double>, cell int, away double"), "placed")
        seen = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
        count = np.array([seen[c]["n"] if c in seen else 0 for c in range(len(middle))], np.int64)
        radius = np.array([seen[c]["radius"] if c in seen else 0.0 for c in range(len(middle))])
        pool = pooled(count)
        held = np.bincount(pool, count, minlength=1) if len(count) else np.zeros(1)
        shelf = shelved(held.astype(np.int64))
        of_cell, of_pool, on = (F.array(*map(F.lit, x)) for x in (pool.tolist() or [0], np.maximum(1, -(-held.astype(np.int64) // BLOCK)).tolist(), shelf.tolist()))

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"pool": rows["pool"][:1].astype(np.int32), "ids": [rows["id"].to_numpy(np.int64).tobytes()], "cells": [rows["cell"].to_numpy(np.int32).tobytes()], "points": [np.stack(rows["vector"]).tobytes()]})

        blocks = placed.withColumn("pool", F.get(of_cell, F.col("cell"))).withColumn("part", F.pmod(F.xxhash64("id"), F.get(of_pool, F.col("pool"))))
        packed = blocks.groupBy("pool", "part").applyInPandas(pack, PACKED).withColumn("shelf", F.get(on, F.col("pool")).cast("int"))
        return cls(written(packed, "blocks"), middle, radius, count, shelf[pool] if len(count) else pool)

    def _sent(self, queries: DataFrame, chosen: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """Queries (q, vector, limit) beside the shelves they visit and the cells there: those ``chosen`` by distance to the centre, least possible distance to a vector, and limit."""
        middle, radius, count, shelf = self.middle, self.radius, self.count, self.shelf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, QUERIES):
                    part = b.slice(i, QUERIES)
                    away = apart(matrix(part.column("vector")), middle)
                    low = np.maximum(0, away - radius - SLACK * (1 + away))
                    row, cell = np.nonzero((count > 0) & chosen(away, low, part.column("limit").to_numpy()[:, None]))
                    order = np.lexsort((cell, shelf[cell], row))
                    row, cell = row[order], cell[order].astype(np.int32)
                    first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(shelf[cell], prepend=-1))
                    cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), pa.array(cell))
                    # A query's vector is repeated for each shelf, so only so many rows are made at a time.
                    for j in range(0, len(first), SENT):
                        at = first[j : j + SENT]
                        whose = pa.array(row[at])
                        yield pa.RecordBatch.from_arrays([part.column("q").take(whose), pa.array(shelf[cell[at]].astype(np.int32)), cells.slice(j, SENT), part.column("vector").take(whose)], ["q", "shelf", "cells", "vector"])

        return queries.select("q", "vector", "limit").mapInArrow(run, "q long, shelf int, cells array<int>, vector array<double>")

    def _visit(self, sent: DataFrame, parts: int, cut: Callable[[np.ndarray], np.ndarray], pick: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """What each query takes of the cells it visits: by products of matrices all vectors up to ``cut``, then by exact distances what ``pick`` leaves of these. Queries meet the blocks of a shelf in ``parts`` blocks of their own, dealt over bands."""
        bands = max(min(parts, BANDS), -(-parts * QUERIES // HELD))

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            cells = rows["cells"]
            return pd.DataFrame({"shelf": rows["shelf"][:1].astype(np.int32), "band": rows["band"][:1].astype(np.int32), "asking": [rows["q"].to_numpy(np.int64).tobytes()], "vectors": [np.stack(rows["vector"]).tobytes()], "sizes": [cells.map(len).to_numpy(np.int32).tobytes()], "visits": [np.concatenate(cells.to_list()).astype(np.int32).tobytes()]})

        def compare(row: dict) -> Iterator[pa.RecordBatch]:
            ids, asking, cells = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asking"], np.int64), np.frombuffer(row["cells"], np.int32)
            points, vectors = np.frombuffer(row["points"]).reshape(len(ids), -1), np.frombuffer(row["vectors"]).reshape(len(asking), -1)
            # Which queries visit which cells of this block; the others have no part in it.
            here, cell = np.unique(cells, return_inverse=True)
            visits, who = np.frombuffer(row["visits"], np.int32), np.repeat(np.arange(len(asking)), np.frombuffer(row["sizes"], np.int32))
            at = np.minimum(np.searchsorted(here, visits), len(here) - 1)
            meets = np.zeros((len(asking), len(here)), bool)
            meets[who[here[at] == visits], at[here[at] == visits]] = True
            some = meets.any(1)
            if not some.any():
                return
            asking, vectors, meets = asking[some], vectors[some], meets[some]
            lengths, others = (points * points).sum(1), (vectors * vectors).sum(1)
            rough = np.sqrt(np.maximum(0, others[:, None] + lengths[None] - 2 * vectors @ points.T))
            if not meets.all():
                rough[~meets[:, cell]] = np.inf
            near = (rough <= (cut(rough) + SLACK * (1 + np.sqrt(max(lengths.max(), others.max()))))[:, None]) & np.isfinite(rough)
            got: list[tuple[np.ndarray, ...]] = []
            for q, vector, mine, seen in zip(asking, vectors, near, np.isfinite(rough).sum(1), strict=True):
                held = np.flatnonzero(mine)
                if len(held):
                    away = apart(vector[None], points[held])[0]
                    at = pick(away, ids[held])
                    got.append((np.full(len(at), q), ids[held][at], away[at], np.where(np.arange(len(at)), 0, seen)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], ["q", "id", "distance", "scored"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Rows come shelf by shelf and band by band: those of one are held, and their pairs made here.
            key, blocks, packs = None, [], []
            for row in chain((row for b in batches for row in b.to_pylist()), [{"shelf": None, "band": None}]):
                if (row["shelf"], row["band"]) != key:
                    for block, asked in product(blocks, packs):
                        yield from compare(block | asked)
                    key, blocks, packs = (row["shelf"], row["band"]), [], []
                if row["shelf"] is not None:
                    (blocks if row["asking"] is None else packs).append({k: v for k, v in row.items() if v is not None})

        packed = sent.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("band", F.col("part") % bands)
        packed = packed.groupBy("shelf", "band", "part").applyInPandas(pack, "shelf int, band int, asking binary, vectors binary, sizes binary, visits binary")
        blocks = self.blocks.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        both = blocks.drop("pool").unionByName(packed, allowMissingColumns=True).repartition("shelf", "band")
        return both.sortWithinPartitions("shelf", "band").mapInArrow(run, FOUND)

    def _asked(self, queries: DataFrame, limit: float = float("inf")) -> tuple[DataFrame, int]:
        """Usable queries with a limit, and in how many blocks they come."""
        rows = usable(queries.select(F.col("q").alias("id"), "vector"), self.middle.shape[1])
        asked = written(rows.select(F.col("id").alias("q"), "vector", F.lit(limit).alias("limit")).dropDuplicates(["q"]), "asked")
        return asked, -(-asked.count() // QUERIES) or 1

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """The ``k`` nearest vectors of every query (q, vector), exactly; ties by id.

        A query first visits the cells nearest to it until they hold ``k`` vectors. The distance
        of the k-th bounds what is left: a cell goes unvisited if even the nearest vector it could
        hold is farther. Returns q, id, distance, rank and scored, the number of vectors that were
        compared with the query.
        """
        if not len(self.count):
            return self.blocks.sparkSession.createDataFrame([], "q long, id long, distance double, rank int, scored long")
        asked, parts = self._asked(queries)
        count = self.count

        def home(away: np.ndarray, low: np.ndarray, limit: np.ndarray) -> np.ndarray:
            order = np.argsort(away, axis=1)
            place = np.minimum((count[order].cumsum(1) < k).sum(1), len(count) - 1)
            each = np.arange(len(away))
            return away <= away[each, order[each, place]][:, None]

        def last(rough: np.ndarray) -> np.ndarray:
            return np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(rough), np.inf)

        def first(away: np.ndarray, ids: np.ndarray) -> np.ndarray:
            return np.lexsort((ids, away))[:k]

        order = Window.partitionBy("q").orderBy("distance", "id")
        begun = written(self._sent(asked, home), "begun")
        seeds = written(self._visit(begun, parts, last, first), "seeds")
        held = seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", (F.col("distance") * (1 + SLACK) + SLACK).alias("known"))
        bound = asked.join(held, "q", "left").select("q", "vector", F.coalesce("known", "limit").alias("limit"))
        # Cells that were visited first are left out of what follows, shelf by shelf.
        later = self._sent(bound, lambda away, low, limit: low <= limit).withColumnRenamed("cells", "all").join(begun.select("q", "shelf", "cells"), ["q", "shelf"], "left")
        later = later.select("q", "shelf", F.array_except("all", F.coalesce("cells", F.array().cast("array<int>"))).alias("cells"), "vector").where(F.size("cells") > 0)
        found = written(seeds.unionByName(self._visit(later, parts, last, first)), "found")
        seen = found.groupBy("q").agg(F.sum("scored").alias("scored"))
        return found.drop("scored").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(seen, "q")

    def within(self, queries: DataFrame, radius: float) -> DataFrame:
        """All vectors at most ``radius`` from each query (q, vector): q, id, distance. Only cells whose ball reaches the query's are visited."""
        asked, parts = self._asked(queries, radius)
        sent = self._sent(asked, lambda away, low, limit: low <= limit)
        return self._visit(sent, parts, lambda rough: np.full(len(rough), radius), lambda away, ids: np.flatnonzero(away <= radius)).drop("scored")


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors at length 1, where distance d means the cosine 1 - d * d / 2; those of length 0 go."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.withColumn("vector", F.col("vector").cast("array<double>")).withColumn("_length", length).where("_length > 0")
    return rows.withColumn("vector", F.transform("vector", lambda x: x / F.col("_length"))).drop("_length")


def similar(vectors: DataFrame, queries: DataFrame, threshold: float, width: int, cells: int | None = None) -> DataFrame:
    """Pairs of a query (q, vector) and a vector (id, vector) with at least that cosine: q, id, similarity. Exact: the index gives all pairs that rounding could bring to the threshold, and their cosines decide."""
    found = VectorIndex.build(unit(vectors), width, cells).within(unit(queries), float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK)
    return found.select("q", "id", (1 - F.col("distance") * F.col("distance") / 2).alias("similarity")).where(F.col("similarity") >= threshold)
