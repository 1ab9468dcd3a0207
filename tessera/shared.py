"""Tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset a local master gets a folder of its own; on a cluster it is an
    error, as executors don't share the driver's local folders.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        got = sc._jsc.sc().getCheckpointDir()
        if not got.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
            got = sc._jsc.sc().getCheckpointDir()
        top = got.get()
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, narrow: bool = False) -> DataFrame:
    """``rows`` of a scan over all cores, where the scan has partitions for at most half of them: a small table in one file would be worked through in one task. A larger one stays as it is,
    unless its rows are ``narrow``: these are dealt out in any case, as a file's row groups may be fewer than the scan's partitions."""
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(max(cores, parts)) if narrow or parts * 2 <= cores else rows
