"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document is the set of its distinct word shingles. Its signature is ``hashes``
MinHash values, each cut to 16 bits. Two signatures within ``distance`` unequal
values must agree, by pigeonhole, up to ``distance // chunks`` values in at least
one of ``chunks`` equal parts; so each part is entered once for every choice of
that many places left out, and equal entries are the candidates. This finds every
pair of signatures within the distance. A pair at the similarity threshold lies
beyond it with probability P(Binomial(hashes, 1 - threshold) > distance), 2e-5 for
the defaults. Candidates are confirmed on whole shingle sets.

Groups are never expanded into all their pairs. Documents with equal sets are one
class. In each bucket every class is first tried against the bucket's smallest.
Afterwards only links between different components matter. Buckets of at most
``direct`` entries give the pairs across their components. The classes of larger
buckets that still hold several components meet on their rarest shingles: a pair at
the threshold must share a shingle within both prefixes, at a position that leaves
room for the overlap its sizes ask for. Edited copies of one text are then told apart
by their edits, not by what all copies share, and the members of a shingle's
commonest component are not compared with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, written
from tessera.llm.textlib import LANE, LOWER, U64, mix, room, slices


@dataclass(frozen=True)
class NearDup:
    """Parameters: shingle length in words, similarity in percent, signature values, chunks, largest signature distance, entries of a bucket paired directly."""

    width: int = 5
    percent: int = 80
    hashes: int = 40
    chunks: int = 10
    distance: int = 19
    direct: int = 16

    def __post_init__(self):
        if self.hashes % self.chunks or self.distance // self.chunks > 1:
            raise ValueError("chunks must divide hashes and allow at most one error each")


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice: first row, pointer by row, and the sorted distinct shingle hashes of all its rows.

    A row with fewer words than ``width`` has its whole sequence as its only shingle; one without words has none.
    """
    for s in slices(column):
        low = LOWER[s.buf]
        s.buf = low
        starts, ends, ptr = s.words()
        words, n = LANE.words(low, starts, ends), np.diff(ptr)
        rows = np.repeat(np.arange(len(s)), n)
        grams = LANE.grams(words, width)
        ok = room(ptr)[: len(grams)] >= width
        key, row = [grams[ok]], [rows[: len(grams)][ok]]
        for short in range(1, width):
            at = np.flatnonzero(n == short)
            if len(at):
                key.append(LANE.grams(words, short)[ptr[at]])
                row.append(at)
        key, row = np.concatenate(key), np.concatenate(row)
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[new], row[new]
        yield s.first, np.searchsorted(row, np.arange(len(s) + 1)), key


def signatures(key: np.ndarray, ptr: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values of each non-empty row, cut to 16 bits."""
    rng = np.random.default_rng(808)
    mult, plus = rng.integers(1, 2**62, hashes, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 2**63, hashes, dtype=np.uint64)
    at = ptr[:-1][np.diff(ptr) > 0]
    out = np.empty((len(at), hashes), np.uint16)
    for k in range(hashes):
        out[:, k] = (mix(np.minimum.reduceat(key * mult[k] + plus[k], at)) & U64(0xFFFF)) if len(at) else 0
    return out


def _sign(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, ptr, key in shingle_sets(b.column(1), p.width):
                n = np.diff(ptr)
                sig = iter(signatures(key, ptr, p.hashes))
                some = [(hashlib.md5(key[i:j].tobytes()).digest(), next(sig).tobytes()) if j > i else (None, None) for i, j in zip(ptr, ptr[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n), pa.array([x for x, _ in some], pa.binary()), pa.array([y for _, y in some], pa.binary())], ["doc_id", "n_shingles", "class_key", "sig"])

    return run


def _entries(p: NearDup):
    """(bucket, id) for each chunk of a signature and each choice of the values left out of it."""
    size, errors = p.hashes // p.chunks, p.distance // p.chunks
    keep = [[i for i in range(size) if i != out] for out in range(size)] if errors else [list(range(size))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, p.hashes).astype(np.uint64)
                out = []
                for c in range(p.chunks):
                    for k, cols in enumerate(keep):
                        h = np.full(len(sig), c * 64 + k + 1, np.uint64)
                        for j in cols:
                            h = mix(h * U64(65599) + sig[:, c * size + j])
                        out.append(h.view(np.int64))
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(ids, len(out)))], ["bucket", "id"])

    return run


def _sets(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, ptr, key in shingle_sets(b.column(1), p.width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(ptr) - 1), pa.array([key[i:j].tobytes() for i, j in zip(ptr, ptr[1:])], pa.binary())], ["id", "shingles"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(2)]
            n = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *(pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in (0, 1)), pa.array(np.repeat(n, n))], ["shingle", "id", "root", "n"])


def _prefix_pairs(sets: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of different roots that may reach the threshold, by prefix, length and positional filters on rarest-first shingles.

    ``sets``: id, root, shingles. A pair's first common shingle in the order of rarity
    stands where the rest of both sets can still hold the overlap that the threshold asks for.
    """
    tokens = written(sets.mapInArrow(_tokens, "shingle long, id long, root long, n long"), "tokens")
    many = tokens.groupBy("shingle").agg(F.count("*").alias("freq")).where("freq > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("freq", F.lit(1)), "shingle"))
    tokens = tokens.join(many, "shingle", "left").withColumn("at", rank).where(f"freq IS NOT NULL AND 100 * (n - at + 1) >= {p.percent} * n")
    tokens = written(tokens.select("shingle", "id", "root", "n", "at"), "prefixes")
    counts = tokens.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    x = tokens.join(main, "shingle").where("root <> main").select("shingle", *(F.col(c).alias(f"{c}_x") for c in ("id", "root", "n", "at")))
    y = tokens.select("shingle", *(F.col(c).alias(f"{c}_y") for c in ("id", "root", "n", "at")))
    fits = f"{100 + p.percent} * (1 + least(n_x - at_x, n_y - at_y)) >= {p.percent} * (n_x + n_y) AND 100 * least(n_x, n_y) >= {p.percent} * greatest(n_x, n_y)"
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("root_x") != F.col("root_y")) & F.expr(fits))
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _close(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _within(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, p.hashes) for c in (2, 3))
                ok = (x != y).sum(1) <= p.distance
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def link(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per row of ``docs``: doc_id, n_shingles (long; size of its shingle
    set), component_id (smallest doc_id reachable over links, itself included), kept
    (doc_id = component_id). Null and empty texts have no shingles and link with nothing.
    Repeated rows each get their row; rows that share a doc_id count as one document.
    A row without doc_id takes no part: its component_id is null and kept is false.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(docs.mapInArrow(_sign(p), "doc_id long, n_shingles long, class_key binary, sig binary"), "signatures")
    # One node per distinct set, under the smallest doc_id that has it.
    nodes = base.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("class_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes, "nodes")
    entries = nodes.select("id", "sig").mapInArrow(_entries(p), "bucket long, id long")
    shared = entries.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    entries = written(entries.join(shared.select("bucket", "pivot"), "bucket"), "entries")

    # The texts are shuffled once and not sorted; every later step takes the shingle sets of these classes.
    shared_ids = entries.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash")
    sets = written(docs.join(shared_ids, "doc_id", "left_semi").mapInArrow(_sets(p), "id long, shingles binary"), "sets")

    def close(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that are within the signature distance, then on whole sets within the similarity."""
        x, y = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        near = pairs.join(x, "a").join(y, "b").where(f"100 * least(n_a, n_b) >= {p.percent} * greatest(n_a, n_b)")
        near = written(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_within(p), "a long, b long"), f"{name}-near")
        x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
        full = near.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b")
        return written(full.mapInArrow(_close(p), "a long, b long"), name)

    pivots = entries.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = close(pivots, "stars")
    roots = components(stars)
    # Buckets that still hold several components: compare across these only.
    at = written(entries.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), "placed")
    mixed = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    few = at.join(mixed.where(f"size <= {p.direct}").select("bucket"), "bucket")
    x, y = (few.select("bucket", F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    rest = x.join(y, "bucket").where("a < b AND root_a <> root_b").select("a", "b")
    crowd = written(at.join(mixed.where(f"size > {p.direct}").select("bucket"), "bucket").select("id", "root").distinct(), "crowd")
    rest = rest.union(_prefix_pairs(sets.join(crowd, "id").select("id", "root", "shingles"), p)).distinct()
    roots = components(stars.union(close(rest.join(pivots, ["a", "b"], "left_anti"), "rest")))

    classes = nodes.join(roots, "id", "left").select(F.col("class_key"), F.coalesce("root", "id").alias("root"))
    rows = base.select("doc_id", "n_shingles", "class_key")
    alone = rows.where("class_key IS NULL").withColumn("root", F.lit(None).cast("long"))  # without shingles: no key to meet under
    out = rows.where("class_key IS NOT NULL").join(classes, "class_key", "left").unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, p: NearDup = NearDup(), once: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that stand first in their component, and those without doc_id.

    Of repeated rows all stay; with ``once``, of those with one doc_id and one text
    (nulls being equal) one. Texts are shuffled once and not sorted: the ids are hashed,
    and only rows that share a doc_id, or have none, are compared by text.
    """
    kept = link(docs, p).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("kept")
    kept = written(kept.select("doc_id", "times"), "kept")

    def having(ids: DataFrame) -> DataFrame:
        return docs.join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")

    nameless = docs.where("doc_id IS NULL")
    if not once:
        return having(kept).union(nameless)
    return having(kept.where("times = 1")).union(having(kept.where("times > 1")).union(nameless).dropDuplicates(["doc_id", "text"]))
