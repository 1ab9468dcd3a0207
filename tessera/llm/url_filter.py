"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

A listed entry is ``host/path``. A URL is looked up under its host and each parent
domain, with its whole canonical path and with ``/`` for the whole host. The list is
hashed into blocks of 256 bits, one bit in each of a block's eight 32-bit words, so a
look-up touches one block. Only URLs that may be listed go on to an exact hash join,
which removes the filter's false positives. The filter's size is bounded
(``max_blocks``); a longer list only lets more URLs on to the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import written

#: Odd multipliers, one for each word of a block.
SALT = [int(x) * 2 + 1 for x in np.random.default_rng(3).integers(2**28, 2**30 - 1, 8)]
WORDS = len(SALT)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def keys(host: Column, path: Column) -> Column:
    """List entries a URL may be found under: its host and each parent domain, each with ``/`` and the canonical path.

    Canonical: no user, port or trailing dot in the host; no index page, ``.html`` or trailing slash in the path.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:\d*)?$", "")
    labels = F.split(name, r"\.")
    domains = F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    page = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    page = F.when(page == "", "/").otherwise(page)
    return F.flatten(F.transform(domains, lambda d: F.array_distinct(F.array(F.concat(d, F.lit("/")), F.concat(d, page)))))


def bloom(listed: DataFrame, max_blocks: int = 1 << 20, bits_per_key: int = 16) -> np.ndarray:
    """Blocked Bloom filter of column ``key``: a row of eight words a block; at most ``max_blocks`` rows (32 MB) reach the driver."""
    n = listed.count()
    blocks = max(1, min(max_blocks, n * bits_per_key // 256 + 1))
    bit = lambda i: F.expr(f"shiftleft(1, cast(shiftright((h & 2147483647) * {SALT[i]}, 26) & 31 AS int))")
    rows = listed.select(F.xxhash64("key").alias("h")).select(F.expr(f"pmod(shiftrightunsigned(h, 32), {blocks})").alias("block"), *(bit(i).alias(f"w{i}") for i in range(WORDS)))
    rows = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))).toPandas()
    out = np.zeros((blocks, WORDS), np.uint32)
    out[rows["block"].to_numpy()] = rows.drop(columns="block").to_numpy(np.int32).view(np.uint32)
    return out


def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    h = h.view(np.uint64)
    block = table[((h >> np.uint64(32)) % np.uint64(len(table))).astype(np.int64)]
    bits = ((h & np.uint64(0x7FFFFFFF))[:, None] * np.array(SALT, np.uint64)) >> np.uint64(26) & np.uint64(31)
    return (block >> bits.astype(np.uint32) & 1).all(1)


def _probe(table):
    """Rows with whether any of their hashes (the last column, which goes) may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            hit = maybe(table.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)) if len(lists.flatten()) else np.zeros(0, bool)
            total = np.concatenate([[0], np.cumsum(hit)])
            ends = np.cumsum(pc_lengths(lists))
            some = total[ends] > total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(some, pa.bool_())], [*b.schema.names[:-1], "maybe"])

    return run


def pc_lengths(lists: pa.Array) -> np.ndarray:
    """Lengths of the lists of an Arrow list column."""
    return np.diff(lists.offsets.to_numpy())


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Verdict on each row of ``pages`` (page_id, url; other columns are ignored).

    ``rules``: (verdict, rule) with a rule of host and path, such as ``("allow",
    "net/de/")``. It fits its host and all subdomains if the URL's path starts with the
    rule's; the longest wins, of equals the last in order of text. ``listed``: column
    ``key``, canonical entries to block; they decide where no rule fits.

    Returns page_id, host, path, rule (null where none fits), verdict. A null URL, or one
    without ``://``, has empty host and path and is allowed. Repeated rows each get
    their verdict. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    listed = listed.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    fits = []
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        ok = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + start)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("best", best)

    table = spark.sparkContext.broadcast(bloom(listed))
    looked = F.transform(F.when(F.col("best").isNull() & (F.col("host") != ""), keys(F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")), lambda k: F.xxhash64(k))
    schema = T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())])
    # Written once: the rows to look up, their entries and the rest are three readings of it.
    tagged = written(rows.withColumn("hashes", looked).mapInArrow(_probe(table), schema), "tagged")
    # Only what the filter lets on is shuffled; every other row has its verdict where it stands.
    some = tagged.where("maybe")
    wanted = some.select("url").distinct().select("url", F.explode(keys(host(F.col("url")), path(F.col("url")))).alias("key"))
    blocked = wanted.join(listed, "key", "left_semi").select("url", F.lit(True).alias("blocked")).distinct()
    out = tagged.where("NOT maybe").withColumn("blocked", F.lit(False)).unionByName(some.join(blocked, "url", "left"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
