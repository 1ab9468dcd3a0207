"""Exact substring dedup with a log-structured fingerprint index.

A word is removed if a window of ``window`` words that covers it also starts
earlier: in a document of smaller doc_id, or earlier in its own. Of every window
the least hash among its ``gram``-word runs is its fingerprint (a minimiser), so
equal windows have equal fingerprints and a text has about one distinct
fingerprint per ``(window - gram + 2) / 2`` words. The index holds these, not all
windows.

``FingerprintIndex.add`` takes the next batch of documents (its ids above those of
earlier batches) and writes it as an immutable run: the fingerprints' postings, the
distinct fingerprints, bucketed and sorted, and the digests of whole texts. The sorted
fingerprints are merge-joined with those of the runs before. Documents that share a
fingerprint with another text are candidates; their windows under shared
fingerprints, and those of the earlier documents they share them with, are
compared by a hash of all words of the window, and verified by a second,
independent hash of the same words: 128 bits. Repeats inside one document are found in
place and verified word by word. When there are more than ``fanout`` runs they are compacted
into one and their files removed. A manifest in the index's folder names the runs, so that
a later session can go on with it.

Work is linear in the rows: shared fingerprints and windows are counted and
reduced to their first place, never expanded into pairs. A text that copies an
earlier one whole is settled by a hash of the text and adds no windows. Postings of a
fingerprint that very many documents hold are spread over tasks: by broadcasting the
shared fingerprints up to ``broadcast_rows`` of them, beyond that by an adaptive join.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, written
from tessera.llm.textlib import CHECK, LANE, U64, Slice, room, slices

TOP = U64(2**64 - 1)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


@dataclass(frozen=True)
class Substring:
    """Words in a window, words in a fingerprint's run, runs kept before they are compacted, rows that may be broadcast."""

    window: int = 20
    gram: int = 8
    fanout: int = 3
    broadcast_rows: int = 1_000_000


def slide(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each run of ``width`` values; shorter runs at the end."""
    out, done = a.copy(), 1
    while done < width:
        step = min(done, width - done)
        if step >= len(out):
            break
        out[:-step] = f(out[:-step], out[step:])
        done += step
    return out


def minimisers(words: np.ndarray, left: np.ndarray, p: Substring) -> np.ndarray:
    """For each word the fingerprint of the window that starts there; 0 where none does."""
    grams = LANE.grams(words, p.gram) | U64(1)
    out = np.zeros(len(words), np.uint64)
    if len(grams):
        grams[left[: len(grams)] < p.gram] = TOP
        out[: len(grams)] = slide(grams, p.window - p.gram + 1, np.minimum)
        out[left < p.window] = 0
    return out


class _Doc:
    """Words, windows and fingerprints of the rows of a slice."""

    def __init__(self, s: Slice, p: Substring):
        self.starts, self.ends, self.ptr = s.words()
        self.left = room(self.ptr)
        self.words = LANE.words(s.buf, self.starts, self.ends)
        self.row = np.repeat(np.arange(len(s)), np.diff(self.ptr))
        self.first = minimisers(self.words, self.left, p)
        self.s, self.p = s, p

    def hashes(self, lane=LANE) -> np.ndarray:
        """Hash of the window at each word; 0 where none starts."""
        words = self.words if lane is LANE else lane.words(self.s.buf, self.starts, self.ends)
        out = np.zeros(len(words), np.uint64)
        g = lane.grams(words, self.p.window) | U64(1)
        out[: len(g)] = g
        out[self.left < self.p.window] = 0
        return out

    def again(self, h: np.ndarray) -> np.ndarray:
        """True at windows that also start earlier in the same row."""
        at = np.flatnonzero(h)
        order = at[np.lexsort((at, h[at], self.row[at]))]
        out = np.zeros(len(h), bool)
        same = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (self.row[order[1:]] == self.row[order[:-1]]))
        x, y = order[same], order[same + 1]
        for k in range(self.p.window):  # word by word
            ok = self.words[x + k] == self.words[y + k]
            x, y = x[ok], y[ok]
        out[y] = True
        return out

    def covered(self, dup: np.ndarray) -> np.ndarray:
        """True at words under a window marked in ``dup``."""
        edge = np.zeros(len(dup) + self.p.window + 1, np.int32)
        at = np.flatnonzero(dup)
        edge[at] += 1
        edge[at + self.p.window] -= 1
        return np.cumsum(edge)[: len(dup)] > 0

    def kept(self, gone: np.ndarray) -> Iterator[bytes]:
        """For each row its kept words, joined by one space."""
        buf = self.s.buf.tobytes()
        for i, j in zip(self.ptr, self.ptr[1:]):
            yield b" ".join([buf[a:b] for a, b in zip(self.starts[i:j][~gone[i:j]].tolist(), self.ends[i:j][~gone[i:j]].tolist())])


def _fingerprints(p: Substring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            for s in slices(b.column(1)):
                d = _Doc(s, p)
                at = np.flatnonzero(d.first)
                # runs of windows share their fingerprint: one of each, then distinct by row
                at = at[np.concatenate([[True], (d.first[at[1:]] != d.first[at[:-1]]) | (d.row[at[1:]] != d.row[at[:-1]])])] if len(at) else at
                at = at[np.lexsort((d.first[at], d.row[at]))]
                if len(at):
                    at = at[np.concatenate([[True], (d.first[at[1:]] != d.first[at[:-1]]) | (d.row[at[1:]] != d.row[at[:-1]])])]
                    row = s.first + d.row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(d.first[at].view(np.int64)), pa.array(texts[row]), pa.array(ids[row].astype(np.int64))], ["fp", "text_key", "doc_id"])

    return run


def _result(ids: pa.Array, d: _Doc, gone: np.ndarray, copy: np.ndarray) -> list[pa.Array]:
    n = np.diff(d.ptr)
    gone = gone | (copy & (n >= d.p.window))[d.row]
    before = np.concatenate([[0], np.cumsum(gone)])
    kept = list(d.kept(gone))
    return [ids, pa.array(n.astype(np.int64)), pa.array((before[d.ptr[1:]] - before[d.ptr[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "replace") for x in kept])]


def _settle(p: Substring):
    """Rows without shared fingerprints are settled; the others go on with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                d, n = _Doc(s, p), len(s)
                ids, text, fps, copy, key = (b.column(i).slice(s.first, n) for i in range(5))
                copy = copy.fill_null(False).to_numpy(zero_copy_only=False)
                open_ = fps.is_valid().to_numpy(zero_copy_only=False) & ~copy
                cols = _result(ids, d, d.covered(d.again(d.hashes())), copy)
                rows = np.arange(n)
                done, todo = pa.array(rows, mask=open_), pa.array(rows, mask=~open_)
                hide = [c.take(done) for c in cols[1:]]
                hide[3] = cols[4].take(pa.array(rows, mask=open_ | (cols[2].to_numpy() == 0)))
                yield pa.RecordBatch.from_arrays([ids, *hide, text.take(todo), fps.take(todo), key], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text", "fps", "text_key"])

    return run


def _windows(p: Substring):
    """One row for each distinct window of a document under a shared fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for s in slices(b.column(1)):
                d = _Doc(s, p)
                part = fps.slice(s.first, len(s))
                flat, n = part.flatten().to_numpy().view(np.uint64), np.diff(part.offsets.to_numpy())
                # membership of (row, fingerprint): both sides hashed with the row
                mark = lambda row, fp: fp * U64(2) ^ (row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                want = np.isin(mark(d.row, d.first), mark(np.repeat(np.arange(len(s)), n), flat)) & (d.first != 0)
                h = d.hashes()
                h[~want] = 0
                at = np.flatnonzero((h != 0) & ~d.again(h))
                if len(at):
                    check = d.hashes(CHECK)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(check), pa.array(ids[s.first + d.row[at]].astype(np.int64))], ["h", "check", "doc_id"])

    return run


def _finish(p: Substring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                d = _Doc(s, p)
                h = d.hashes()
                part = b.column(2).slice(s.first, len(s))
                flat, n = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.diff(part.offsets.to_numpy())
                # every window of the row that equals one found elsewhere, and repeats
                mark = lambda row, x: x * U64(3) ^ (row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
                dup = (np.isin(mark(d.row, h), mark(np.repeat(np.arange(len(s)), n), flat)) | d.again(h)) & (h != 0)
                yield pa.RecordBatch.from_arrays(_result(b.column(0).slice(s.first, len(s)), d, d.covered(dup), np.zeros(len(s), bool)) + [b.column(3).slice(s.first, len(s))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text_key"])

    return run


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class FingerprintIndex:
    """Immutable runs in a shared folder, oldest first; a folder that has a manifest is opened at its last version."""

    spark: SparkSession
    params: Substring = field(default_factory=Substring)
    path: str = ""
    runs: list[tuple[str, int]] = field(default_factory=list)
    version: int = 0

    def __post_init__(self):
        if not self.path:
            self.path = f"{shared_dir(self.spark)}/index"
            return
        rows = self.spark.read.schema("run string, buckets int, place int, version int").parquet(f"{self.path}/manifest")
        self.version = rows.agg(F.max("version")).first()[0]
        self.runs = [(r["run"], r["buckets"]) for r in rows.where(F.col("version") == self.version).orderBy("place").collect()]  # at most ``fanout`` + 1

    def _commit(self) -> None:
        """The manifest's next version; readers of an earlier one aren't disturbed until its runs are removed."""
        self.version += 1
        rows = [(run, buckets, k, self.version) for k, (run, buckets) in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "run string, buckets int, place int, version int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _part(self, run: str, part: str) -> DataFrame:
        return self.spark.read.schema({"postings": "fp long, text_key long, doc_id long", "texts": "digest binary, first long"}[part]).parquet(f"{self.path}/{run}/{part}")

    def _sorted(self, run: str, buckets: int) -> DataFrame:
        """A run's distinct fingerprints, bucketed and sorted, so that a join of two runs is a merge without exchange."""
        name = f"tessera_{run}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}/sorted'")
        return self.spark.table(name)

    def _write(self, postings: DataFrame, texts: DataFrame, distinct: DataFrame | None = None) -> tuple[str, int]:
        """A run. ``lo`` and ``hi`` are the least and greatest text with the fingerprint, ``hi`` null where they are one."""
        run, n = f"run_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings.write.option("compression", "zstd").parquet(f"{self.path}/{run}/postings")
        texts.write.option("compression", "zstd").parquet(f"{self.path}/{run}/texts")
        if distinct is None:
            distinct = self._part(run, "postings").select("fp", F.col("text_key").alias("lo"), F.col("text_key").alias("hi"))
        distinct = distinct.groupBy("fp").agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi")).select("fp", "lo", F.nullif("hi", "lo").alias("hi"))
        distinct.repartition(n, "fp").write.bucketBy(n, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.path}/{run}/sorted").saveAsTable(f"tessera_{run}")
        return run, n

    def _union(self, part: str) -> DataFrame:
        out = self._part(self.runs[0][0], part)
        for run, _ in self.runs[1:]:
            out = out.union(self._part(run, part))
        return out

    def compact(self) -> None:
        """Merges all runs into one and removes their files."""
        if len(self.runs) < 2:
            return
        old, distinct = self.runs, self._sorted(*self.runs[0])
        for run in old[1:]:
            distinct = distinct.union(self._sorted(*run))
        few = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs = [self._write(self._union("postings").coalesce(few), self._union("texts").groupBy("digest").agg(F.min("first").alias("first")), distinct)]
        self._commit()
        for run, _ in old:
            self.spark.sql(f"DROP TABLE tessera_{run}")
            _remove(self.spark, f"{self.path}/{run}")

    def _small(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= self.params.broadcast_rows else rows

    def add(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Judges a batch against itself and all earlier batches, and enters it into the index.

        ``history``: the documents of the earlier batches (doc_id, text), of which those
        that share a fingerprint with the batch are read. Returns doc_id, n_words, n_removed,
        kept_sha256 (of the kept words joined by one space), kept_text (null where nothing
        was removed) and text_key, the hash of the row's text, a row for each row of ``docs``.
        Null text counts as empty. Rows repeated with their doc_id count as one document; rows
        that share a doc_id but not a text lose what a smaller doc_id has, each by its own words,
        but nothing to each other. Rows without doc_id are judged on their own text only. An
        empty batch gives an empty result and an empty run.
        """
        p = self.params
        if self.runs and history is None:
            raise ValueError("an index with runs needs the documents they were made of")
        pick = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
        docs, digest = docs.select(*pick), F.unhex(F.md5("text")).alias("digest")
        known = docs.where("doc_id IS NOT NULL")
        texts = known.select("doc_id", digest)
        run = self._write(
            known.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_fingerprints(p), "fp long, text_key long, doc_id long"),
            texts.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first")),
        )
        # Merge join of the new run with the older ones: fingerprints of more than one text.
        seen = self._sorted(*run).withColumnsRenamed({"lo": "lo0", "hi": "hi0"})
        for k, r in enumerate(self.runs, 1):
            seen = seen.join(self._sorted(*r).withColumnsRenamed({"lo": f"lo{k}", "hi": f"hi{k}"}), "fp", "left")
        bounds = [c for k in range(len(self.runs) + 1) for c in (f"lo{k}", f"hi{k}")]
        shared = self._small(written(seen.where(F.least(*bounds) < F.greatest(*bounds)).select("fp"), "shared"))
        by_doc = lambda postings: postings.join(shared, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
        # Whole copies: the text's digest stands under a smaller doc_id.
        firsts = self._part(run[0], "texts")
        if self.runs:
            firsts = firsts.union(self._union("texts")).groupBy("digest").agg(F.min("first").alias("first"))
        copies = texts.join(firsts, "digest").where("first < doc_id").groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
        plan = by_doc(self._part(run[0], "postings")).join(copies, "doc_id", "full")
        work = docs.join(plan, "doc_id", "left").select("doc_id", "text", "fps", F.array_contains("copied", digest).alias("copy"), F.xxhash64("text").alias("text_key"))
        work = written(work.mapInArrow(_settle(p), f"{RESULT}, kept_text string, text string, fps array<long>, text_key long"), "work")
        todo = work.where("fps IS NOT NULL")
        rows = todo.select("doc_id", "text", "fps")
        if self.runs:
            old = written(by_doc(self._union("postings")), "old")
            some = history.select(*pick).join(self._small(old.select("doc_id")), "doc_id", "left_semi")
            rows = rows.union(some.join(old, "doc_id").select("doc_id", "text", "fps"))
        windows = rows.mapInArrow(_windows(p), "h long, check long, doc_id long")
        first = windows.groupBy("h", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
        dup = written(windows.join(first, ["h", "check"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_set("h").alias("found")), "dup")
        late = todo.select("doc_id", "text", "text_key").join(dup, "doc_id", "left").select("doc_id", "text", F.coalesce("found", F.array().cast("array<long>")).alias("found"), "text_key")
        late = late.mapInArrow(_finish(p), f"{RESULT}, kept_text string, text_key long")
        late = late.withColumn("kept_text", F.expr("CASE WHEN n_removed > 0 THEN kept_text END"))
        self.runs.append(run)
        if len(self.runs) > p.fanout:
            self.compact()
        else:
            self._commit()
        return work.where("fps IS NULL").select(*late.columns).union(late)


def dedup(docs: DataFrame, p: Substring = Substring(), batches: int = 5) -> DataFrame:
    """All rows of ``docs`` through a new index, in ``batches`` of about equal size by ascending doc_id; columns and cases as of ``FingerprintIndex.add``.

    Each batch's rows are written when they are judged, so the plan of the result is one scan, however many batches there are.
    """
    index = FingerprintIndex(docs.sparkSession, p)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    path, low = f"{shared_dir(docs.sparkSession)}/judged", None
    for high in [*cuts, None]:
        above = F.col("doc_id").isNull() if low is None else F.lit(False)  # rows without doc_id go with the first batch
        inside = (F.lit(True) if low is None else F.col("doc_id") > low) & (F.lit(True) if high is None else F.col("doc_id") <= high)
        got = index.add(docs.where(inside | above), docs.where(F.col("doc_id") <= low) if low is not None else None)
        # One plan of all batches would hold every batch's joins on the driver at once.
        got.write.mode("append").option("compression", "zstd").parquet(path)
        low = high
    return docs.sparkSession.read.schema(got.schema).parquet(path)
