"""An inverted index of trigrams, for a table of query texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tessera.operators.search import plain_words, trigram_codes
from tessera.shared import spread, written

#: Texts whose posting lists are made together: a trigram that most texts hold has a list for each such block.
LIST = 4096
#: Most rows of queries' trigrams that are sent to the lists; more of them meet by a shuffle.
SENT = 500_000
#: Most queries that are inverted instead of the texts, and texts that are compared with them together.
ASKED, TEXTS = 4096, 512
#: A query's rarest trigrams are looked up first, until so many postings for each wanted row are at hand.
SEEDS = 8


def with_grams(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``grams``, the distinct trigrams of a text column as sorted numbers, and ``n``, how many; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [trigram_codes(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.list_(pa.int64())), pa.array(list(map(len, sets)), pa.int32())], [*b.schema.names[:-1], "grams", "n"])

    schema = T_.StructType([*rows.schema.fields, T_.StructField("grams", T_.ArrayType(T_.LongType())), T_.StructField("n", T_.IntegerType())])
    return rows.withColumn("_plain", plain_words(F.col(text))).mapInArrow(run, schema)


def share(both: Column, a: Column, b: Column) -> Column:
    """Similarity of two sets of sizes ``a`` and ``b``: what is in both of what is in either; 0 for two empty ones."""
    return F.coalesce(F.try_divide(both, a + b - both), F.lit(0.0))


@dataclass(frozen=True)
class TrigramIndex:
    """``sets``: key, grams, n of every text. ``lists``: gram, keys and ns of about ``LIST`` texts at most. ``known``: gram and df, in how many texts it is."""

    sets: DataFrame
    lists: DataFrame
    known: DataFrame

    @classmethod
    def build(cls, texts: DataFrame) -> TrigramIndex:
        """Indexes ``texts`` (key, text); keys are long numbers, each once. Texts without a word have no trigram and can't be found.

        A task inverts about ``LIST`` texts at a time, so no posting is shuffled and no list grows with
        the table; lists come sorted by trigram, which lets a scan for few trigrams skip most.
        """
        sets = written(with_grams(spread(texts.select("key", "text")), "text").drop("text"), "sets")

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def lists() -> pa.RecordBatch:
                rows = pa.Table.from_batches(held).combine_chunks()
                n = rows.column("n").to_numpy()
                gram = rows.column("grams").combine_chunks().flatten().to_numpy()
                order = np.argsort(gram, kind="stable")
                at = np.repeat(np.arange(len(n)), n)[order]
                each, first = np.unique(gram[order], return_index=True)
                cuts = pa.array(np.append(first, len(at)).astype(np.int32))
                keys, sizes = (pa.ListArray.from_arrays(cuts, pa.array(x[at])) for x in (rows.column("key").to_numpy(), n))
                return pa.RecordBatch.from_arrays([pa.array(each), keys, sizes], ["gram", "keys", "ns"])

            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= LIST:
                    yield lists()
                    held.clear()
            if held:
                yield lists()

        lists = written(sets.mapInArrow(invert, "gram long, keys array<long>, ns array<int>"), "lists")
        return cls(sets, lists, written(lists.groupBy("gram").agg(F.sum(F.size("keys")).alias("df")), "known"))

    def _met(self, grams: DataFrame, where: Column | None = None, small: bool = False) -> DataFrame:
        """For (q, gram, m; and more): q, key, the sizes m and n, and in how many of the trigrams both meet. Where the grams are few they go to the lists, and a block's postings are counted in its task."""
        posts = self.lists.join(F.broadcast(grams) if small else grams, "gram").select("q", "m", F.explode(F.arrays_zip("keys", "ns")).alias("x"), *(c for c in ("least", "left") if c in grams.columns))
        rows = posts.select(F.col("x.keys").alias("key"), F.col("x.ns").alias("n"), *(c for c in posts.columns if c != "x"))
        rows = rows.where(where) if where is not None else rows
        keys = [c for c in rows.columns if c not in ("q", "key")]
        return rows.groupBy("q", "key").agg(F.count("*").alias("met"), *(F.max(c).alias(c) for c in keys))

    def _scored(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs (q, key) with their similarity, by their whole sets."""
        both = pairs.select("q", "key").join(self.sets, "key").join(asked.select("q", F.col("grams").alias("own"), "m"), "q")
        return both.select("q", "key", share(F.size(F.array_intersect("grams", "own")), F.col("m"), F.col("n")).alias("similarity"))

    def top(self, queries: DataFrame, k: int, least: float = 1e-6) -> DataFrame:
        """The ``k`` texts of greatest trigram similarity above ``least`` for each of ``queries`` (q, text): q, key, similarity, rank; ties by key.

        First a query's rarest trigrams give texts whose similarity bounds the k-th. A text that
        reaches this bound has between bound * m and m / bound trigrams and holds at least one of the
        query's m - bound * m + 1 rarest; only lists of these are read, and a text is compared in
        full only if the trigrams not looked up could still bring it to the bound.
        """
        asked = written(with_grams(queries.select("q", "text"), "text").select("q", "grams", F.col("n").alias("m")).where("m > 0"), "asked")
        rare = Window.partitionBy("q").orderBy("df", "gram")
        grams = asked.select("q", "m", F.explode("grams").alias("gram")).join(self.known, "gram")
        grams = written(grams.withColumn("place", F.row_number().over(rare)).withColumn("before", F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1))), "grams")
        small = grams.count() <= SENT
        order = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
        seeds = self._met(grams.where(F.coalesce("before", F.lit(0)) < SEEDS * k).select("q", "m", "gram"), small=small)
        seeds = seeds.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(share(F.col("met"), F.col("m"), F.col("n"))), "key"))).where(F.col("place") <= 2 * k)
        seeds = self._scored(seeds, asked).withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
        bound = asked.select("q").join(seeds.select("q", F.col("similarity").alias("kth")), "q", "left").select("q", F.greatest(F.coalesce("kth", F.lit(0.0)) * (1 - 1e-9), F.lit(least)).alias("least"))

        # Trigrams no text holds can't be met, so what must be met is met among the known ones.
        held = grams.groupBy("q").agg(F.count("*").alias("held"))
        need = F.ceil(F.col("least") * F.col("m") - 1e-9)
        prefix = grams.join(bound, "q").join(held, "q").withColumn("left", F.greatest(need - 1, F.lit(0)).cast("int")).where(F.col("place") <= F.col("held") - F.col("left"))
        fits = (F.col("n") >= F.col("least") * F.col("m") - 1e-9) & (F.col("n") * F.col("least") <= F.col("m") + 1e-9)
        met = self._met(prefix.select("q", "m", "gram", "least", "left"), fits, small)
        most = F.least(F.col("met") + F.col("left"), F.col("m"), F.col("n"))
        met = written(met.withColumn("whole", F.col("left") == 0).where(share(most, F.col("m"), F.col("n")) >= F.col("least")), "met")
        sure = met.where("whole").select("q", "key", share(F.col("met"), F.col("m"), F.col("n")).alias("similarity"))
        found = sure.unionByName(self._scored(met.where("NOT whole"), asked)).where(F.col("similarity") > least)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def pairs(self, least: float = 1e-6) -> DataFrame:
        """Pairs of indexed texts above that similarity: a_id, b_id (the greater key), similarity. Texts meet in the lists of their trigrams, never without one in common."""
        mine = self.sets.select(F.col("key").alias("q"), F.col("n").alias("m"), F.explode("grams").alias("gram"))
        met = self._met(mine, F.col("q") < F.col("key"))
        return met.select(F.col("q").alias("a_id"), F.col("key").alias("b_id"), share(F.col("met"), F.col("m"), F.col("n")).alias("similarity")).where(F.col("similarity") > least)


def top(texts: DataFrame, queries: DataFrame, k: int, least: float = 1e-6) -> DataFrame:
    """The ``k`` of ``texts`` (key, text) of greatest trigram similarity above ``least`` for each of ``queries`` (q, text; q a long number): q, key, similarity, rank; ties by key.

    Up to ``ASKED`` queries are inverted themselves: every text passes the lists of their trigrams once, which counts what it
    shares with each query, and a task keeps its best ``k``. Nothing of the texts is written or
    shuffled but these. More queries are looked up in an index of the texts; the result is the same.
    """
    asked = written(with_grams(queries.select(F.col("q").cast("long").alias("q"), "text"), "text").select("q", "grams", "n").where("n > 0"), "asked")
    if asked.count() > ASKED:
        return TrigramIndex.build(texts).top(queries, k, least)
    known = asked.toArrow().combine_chunks()
    ids, sizes = (known.column(c).to_numpy().astype(np.int64) for c in ("q", "n"))
    gram = np.concatenate([np.asarray(x.as_py(), np.int64) for x in known.column("grams")]) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")
    owner = np.repeat(np.arange(len(ids)), sizes)[order]
    grams, first = np.unique(gram[order], return_index=True)
    ends = np.append(first[1:], len(owner)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, held = np.zeros((0, len(ids))), np.zeros((0, len(ids)), np.int64)
        for b in batches:
            for i in range(0, b.num_rows if len(ids) else 0, TEXTS):
                part = b.slice(i, TEXTS)
                mine = [trigram_codes(x or "").astype(np.int64) for x in part.column("_plain").to_pylist()]
                n = np.array(list(map(len, mine)))
                flat, row = np.concatenate(mine), np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
                hit = grams[at] == flat
                at, row = at[hit], row[hit]
                many = ends[at] - first[at]
                post = np.repeat(first[at] - (many.cumsum() - many), many) + np.arange(many.sum())
                both = np.bincount(np.repeat(row, many) * len(ids) + owner[post], minlength=len(n) * len(ids)).reshape(len(n), -1)
                keys = part.column("key").to_numpy()
                score = np.concatenate([score, both / np.maximum(1, n[:, None] + sizes[None] - both)])
                held = np.concatenate([held, np.broadcast_to(keys[:, None], both.shape)])
                best = np.lexsort((held, -score), axis=0)[:k]
                score, held = np.take_along_axis(score, best, 0), np.take_along_axis(held, best, 0)
        some = score > least
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids, score.shape)[some]), pa.array(held[some]), pa.array(score[some])], ["q", "key", "similarity"])

    rows = spread(texts.select(F.col("key").cast("long").alias("key"), "text")).select("key", plain_words(F.col("text")).alias("_plain"))
    found = rows.mapInArrow(run, "q long, key long, similarity double")
    place = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
