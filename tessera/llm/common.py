"""Connected components, and tables in the shared folder for the operators here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import shared_dir, written

__all__ = ["components", "shared_dir", "written"]


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components by minimum-label propagation with pointer jumping.

    ``edges`` has long columns ``a`` and ``b``. Returns ``id``, ``root`` (the
    smallest id reachable) for every id on an edge. Each round is a join and a
    map-side combined minimum; nothing but a count of changes reaches the driver.
    Jumping to the label's own label halves the distance left in each round.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = step.join(jump, "root", "left").select("id", F.least("root", "far").alias("root"), "old")
        step = written(step, "labels")
        labels = step.select("id", "root")
        if step.where("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
