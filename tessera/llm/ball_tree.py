"""Centroid clustering by ball-tree filtering: whole balls go to one centroid where the triangle inequality allows it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.vectorlib import integers, products, usable

#: Vectors of a tree, which bounds a task's memory, and of a leaf at most.
TREE, LEAF = 4096, 16
#: Room for rounding in distances that are compared as floats; what lies within it is decided on integers.
SLACK = 1e-7

PLANTED = "ids array<long>, points binary, radius array<double>, sums binary, squares array<long>"
ADDED = "cluster int, n long, sums array<long>, inertia long"
FOUND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Tree:
    """A balanced metric tree over integer vectors, which lie in the order of its leaves.

    Level k has 2**k nodes, one after another by level; node j of a level has the children
    2j and 2j + 1 of the next. ``sums`` and ``squares`` hold each node's integer sums of vectors
    and of their squared lengths; ``order`` says where each vector stood when the tree was planted.
    """

    order: np.ndarray | None
    points: np.ndarray
    radius: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def plant(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halves every node at the median of its widest component until leaves have at most ``leaf`` vectors."""
        depth = max(0, int(np.ceil(np.log2(len(points) / leaf))))
        order = np.arange(len(points))
        for level in range(depth):
            cuts = edges(len(points), level)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = points[order[a:b]]
                wide = np.argmax(own.max(0) - own.min(0))
                order[a:b] = order[a:b][np.argpartition(own[:, wide], halfway(a, b) - a)]
        points = points[order]
        radius, sums, squares = [], [], []
        lengths = (points * points).sum(1)
        for level in range(depth + 1):
            cuts = edges(len(points), level)
            total, count = np.add.reduceat(points, cuts[:-1]), np.diff(cuts)
            apart = points - np.repeat(total / count[:, None], count, 0)
            radius.append(np.sqrt(np.maximum.reduceat((apart * apart).sum(1), cuts[:-1])))
            sums.append(total)
            squares.append(np.add.reduceat(lengths, cuts[:-1]))
        return cls(order, points, np.concatenate(radius), np.concatenate(sums), np.concatenate(squares))

    def split(self, centroids: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Where the tree's vectors belong; of equally near centroids to the first.

        First whole balls: their node, first and last vector, centroid. Then the vectors of
        leaves that more than one centroid could win: their place, centroid and squared distance. A
        centroid is out for a ball when even the ball's nearest point is farther from it than the farthest one is from another.
        """
        n, levels = len(self.points), int(np.log2(len(self.radius) + 1))
        balls, none = [], np.zeros(0, np.int64)
        nodes, alive, single = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool), (none, none, none)
        for level in range(levels):
            cuts = edges(n, level)
            first, last, at = cuts[nodes], cuts[nodes + 1], nodes + 2**level - 1
            middle, reach = self.sums[at] / (last - first)[:, None], self.radius[at][:, None]
            away = np.sqrt(((middle[:, None, :] - centroids[None, :, :]) ** 2).sum(2))
            bound = np.where(alive, away + reach, np.inf).min(1, keepdims=True)
            alive &= away - reach <= bound + SLACK * (1 + bound)
            sure = alive.sum(1) == 1
            balls.append((at[sure], first[sure], last[sure], alive[sure].argmax(1)))
            if sure.all():
                break
            if level + 1 < levels:
                nodes, alive = np.stack([2 * nodes[~sure], 2 * nodes[~sure] + 1], 1).ravel(), np.repeat(alive[~sure], 2, 0)
                continue
            place = np.concatenate([np.arange(a, b) for a, b in zip(first[~sure], last[~sure], strict=True)])
            apart = distances(self.points[place], centroids)
            apart[~np.repeat(alive[~sure], (last - first)[~sure], 0)] = np.iinfo(np.int64).max
            single = (place, apart.argmin(1), apart.min(1))
        return tuple(np.concatenate(x) for x in zip(*balls, strict=True)), single

    def added(self, centroids: np.ndarray) -> Iterator[dict]:
        """For each centroid that gets vectors: how many, their sum, and the sum of their squared distances."""
        k = len(centroids)
        count, total, inertia = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64), np.zeros(k, np.int64)
        (node, first, last, whole), (place, near, apart) = self.split(centroids)
        np.add.at(count, whole, last - first)
        np.add.at(total, whole, self.sums[node])
        mine = centroids[whole]
        np.add.at(inertia, whole, self.squares[node] - 2 * (mine * self.sums[node]).sum(1) + (last - first) * (mine * mine).sum(1))
        np.add.at(count, near, 1)
        np.add.at(total, near, self.points[place])
        np.add.at(inertia, near, apart)
        for c in np.flatnonzero(count):
            yield {"cluster": int(c), "n": int(count[c]), "sums": total[c].tolist(), "inertia": int(inertia[c])}

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every vector."""
        cluster, apart = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        (_, first, last, whole), (place, near, far) = self.split(centroids)
        for a, b, c in zip(first, last, whole, strict=True):
            cluster[a:b] = c
            apart[a:b] = distances(self.points[a:b], centroids[c : c + 1])[:, 0]
        cluster[place], apart[place] = near, far
        return cluster, apart

    def row(self, ids: pa.Array) -> tuple:
        """The tree as a row of ``PLANTED``."""
        return ids.to_pylist(), self.points.astype(np.int32).tobytes(), self.radius.tolist(), self.sums.tobytes(), self.squares.tolist()

    @classmethod
    def of(cls, row: dict) -> Tree:
        radius, n = np.array(row["radius"]), len(row["ids"])
        return cls(None, np.frombuffer(row["points"], np.int32).reshape(n, -1).astype(np.int64), radius, np.frombuffer(row["sums"], np.int64).reshape(len(radius), -1), np.array(row["squares"], np.int64))


def halfway(a: int, b: int) -> int:
    return a + (b - a) // 2


def edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    cuts = [0, n]
    for _ in range(level):
        cuts = [*(x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in (a, halfway(a, b))), n]
    return np.array(cuts)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    return (points * points).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * products(points, centroids)


def planted(vectors: DataFrame, size: int = TREE) -> DataFrame:
    """Trees of at most ``size`` vectors (vec_id, v; of one length), each of vectors of one partition; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            got = Tree.plant(integers(rows.column("v").combine_chunks()))
            ids = rows.column("vec_id").combine_chunks().take(pa.array(got.order))
            return pa.RecordBatch.from_pydict({c: [x] for c, x in zip(("ids", "points", "radius", "sums", "squares"), got.row(ids), strict=True)})

        for b in batches:
            while b.num_rows:
                space = size - sum(x.num_rows for x in held)
                held.append(b.slice(0, space))
                b = b.slice(space)
                if sum(x.num_rows for x in held) == size:
                    yield tree()
                    held.clear()
        if held:
            yield tree()

    return vectors.select("vec_id", "v").mapInArrow(run, PLANTED)


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int | None]]:
    """Count, sum and inertia of each centroid's vectors; one row a centroid and task is shuffled, one a centroid reaches the driver."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"cluster": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64()), "inertia": pa.int64()})
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pylist(list(Tree.of(row).added(centroids)), schema)

    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    got = trees.mapInArrow(run, ADDED).groupBy("cluster").agg(F.sum("n").alias("n"), F.try_sum("inertia").alias("inertia"), *sums).collect()
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(width)], r["inertia"]) for r in got}


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> DataFrame:
    """Lloyd's rounds over integer vectors (vec_id, embedding; other columns are ignored), exact and alike at any partitioning.

    Vectors of ``width`` components take part, none of them null or not finite (nor beyond
    2**27 once integer: its squared distance would not fit a long). The first centroids are the ``k`` of
    least sha256 of ``seed:vec_id``; rows that share an id start by their vectors' order, rows
    without id never start while others can. Fewer than ``k`` vectors make fewer
    clusters; equal centroids are told apart by number, and the later ones stay empty.

    Each partition's vectors are planted as metric trees, which are written once to the
    shared folder. A round takes whole balls where it can and reads single vectors only in
    leaves; what tasks send on is one count and sum a centroid.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia (null where beyond
    a long) and centroid_sha256, a row for each vector that takes part, repeated rows included.
    An empty table gives an empty result.
    """
    vector = F.col("embedding")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where((F.size("v") == width) & usable(F.col("v")))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").toArrow()
    if not first.num_rows:
        return rows.sparkSession.createDataFrame([], FOUND)
    centroids = integers(first.column("v").combine_chunks())
    trees = written(planted(kept), "trees")
    for _ in range(rounds):
        for c, (n, total, _) in totals(trees, centroids).items():
            centroids[c] = [s // n for s in total]
    ends = totals(trees, centroids)
    own = [ends[c][2] if c in ends else 0 for c in range(len(centroids))]
    inertia = sum(own) if None not in own and sum(own) < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, names = pa.array(own, pa.int64()), pa.array(digest)
        for b in batches:
            for row in b.to_pylist():
                got, apart = Tree.of(row).assigned(centroids)
                got = pa.array(got.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), got, pa.array(apart), each.take(got), pa.array([inertia] * len(got), pa.int64()), names.take(got)],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return trees.mapInArrow(run, FOUND)
