"""Collection trees and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import written

LEVELS = {"VIEW": 1, "EDIT": 2, "MANAGE": 3}


def level(col: str = "permission"):
    """Rank of a permission; a higher one includes the lower."""
    out = F
    for name, n in LEVELS.items():
        out = out.when(F.col(col) == name, n)
    return out.otherwise(0)


def latest_grants(grants: DataFrame) -> DataFrame:
    """One grant for each user and collection: the last by grant_id."""
    return grants.groupBy("user_id", "collection_id").agg(F.max("grant_id").alias("grant_id"), F.max_by("permission", "grant_id").alias("permission"))


def direct(grants: DataFrame, least: str) -> DataFrame:
    """Collections a user may search: direct grants of at least a level, nothing inherited."""
    return grants.where(level() >= LEVELS[least]).select("user_id", "collection_id").distinct()


def ancestors(collections: DataFrame) -> DataFrame:
    """Each collection (id, parent_id) with itself and all above it: id, ancestor_id, depth (the least, should links form a cycle).

    Steps double: once all ancestors nearer than n are known with the one at n, those of
    that one are the next n, and its own n-th is the one at 2n. So the rounds are the logarithm of the
    depth, each written to the shared folder, and none that brings no new pair is followed by another, which ends cycles.
    """
    found = collections.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"))
    jump = written(collections.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("far")).join(collections.select(F.col("id").alias("far")), "far", "left_semi"), "jump")
    # A parent that is no collection itself is an ancestor with nothing above it.
    outside = collections.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("far")).join(collections.select(F.col("id").alias("far")), "far", "left_anti")
    step = 1
    while True:
        near = found.withColumnsRenamed({"id": "far", "ancestor_id": "over", "depth": "more"})
        new = jump.join(near, "far").groupBy("id", F.col("over").alias("ancestor_id")).agg(F.min(F.col("more") + step).cast("int").alias("depth"))
        new = written(new.join(found.select("id", "ancestor_id"), ["id", "ancestor_id"], "left_anti").select("id", "ancestor_id", "depth"), "above")
        if new.isEmpty():
            break
        found = found.union(new)
        jump = written(jump.join(jump.select(F.col("id").alias("far"), F.col("far").alias("farther")), "far").select("id", F.col("farther").alias("far")), "jump")
        step *= 2
    over = found.join(outside.select(F.col("id").alias("ancestor_id"), F.col("far").alias("out")), "ancestor_id").select("id", F.col("out").alias("ancestor_id"), (F.col("depth") + 1).alias("depth"))
    return written(found.union(over), "ancestors")


def inherited(collections: DataFrame, grants: DataFrame, least: str) -> DataFrame:
    """Collections a user may open: a grant of at least the level on it or above it."""
    return ancestors(collections).join(direct(grants, least).withColumnRenamed("collection_id", "ancestor_id"), "ancestor_id").select("user_id", F.col("id").alias("collection_id")).distinct()


def permission_source(collections: DataFrame, grants: DataFrame) -> DataFrame:
    """For each collection the nearest of itself and its ancestors that has any grant."""
    has = grants.select(F.col("collection_id").alias("ancestor_id")).distinct()
    return ancestors(collections).join(has, "ancestor_id").groupBy("id").agg(F.min_by("ancestor_id", "depth").alias("source_id"))


def owners(grants: DataFrame) -> DataFrame:
    """The user of each collection's lowest MANAGE grant."""
    return grants.where("permission = 'MANAGE'").groupBy("collection_id").agg(F.min_by("user_id", "grant_id").alias("owner_id"))


def paths(collections: DataFrame) -> DataFrame:
    """``a/b/c`` of each collection (id, parent_id, name)."""
    up = ancestors(collections).join(collections.select(F.col("id").alias("ancestor_id"), "name"), "ancestor_id")
    ordered = F.sort_array(F.collect_list(F.struct("depth", "name")), False)
    return up.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), "/").alias("path"), F.max("depth").alias("depth"))


def moves(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted moves (id, new_parent_id) with whether they would close a cycle."""
    below = ancestors(collections).select(F.col("id").alias("new_parent_id"), F.col("ancestor_id").alias("id"), F.lit(True).alias("hit"))
    return wanted.join(below, ["id", "new_parent_id"], "left").select("id", "new_parent_id", F.coalesce("hit", F.lit(False)).alias("cycle"))


def mirror(source: DataFrame, target: DataFrame) -> DataFrame:
    """Changes that make the grants of ``target`` those of ``source`` (user_id, permission): insert, update or delete."""
    a, b = source.select("user_id", F.col("permission").alias("want")), target.select("user_id", F.col("permission").alias("have"))
    rows = a.join(b, "user_id", "full")
    return rows.withColumn("change", F.when(F.col("have").isNull(), "insert").when(F.col("want").isNull(), "delete").when(F.col("want") != F.col("have"), "update")).where("change IS NOT NULL")


def counted_tree(collections: DataFrame, items: DataFrame) -> DataFrame:
    """Each collection with its depth, path and number of items (collection_id); those whose parent is missing are roots."""
    known = collections.select(F.col("id").alias("known"))
    fixed = collections.join(known, F.col("parent_id") == F.col("known"), "left").select("id", F.col("known").alias("parent_id"), "name")
    counts = items.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n_items"))
    return paths(fixed).join(counts, "id", "left").select("id", "path", "depth", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def nearest_wins(rows: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= n).drop("rn")


def viewers_only(grants: DataFrame) -> DataFrame:
    """User and collection of every grant to view without one to edit or manage the same collection."""
    pairs = lambda rows: rows.select("user_id", "collection_id").distinct()
    return pairs(grants.where("permission = 'VIEW'")).join(pairs(grants.where("permission IN ('EDIT', 'MANAGE')")), ["user_id", "collection_id"], "left_anti")


def related(rows: DataFrame, key: str, order: str, visible: Column, most: int = 3) -> DataFrame:
    """At most ``most`` visible rows of each key, of the first three times as many by ``order``: what lies beyond is not looked at, visible or not."""
    w = Window.partitionBy(key).orderBy(order)
    near = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 3 * most).where(visible)
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
