"""Whole-table queries against their SQL on another engine and against brute force."""

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import evidence
from tests.test_queries import DATA, rows, sql  # noqa: F401


ACCESS = [f"access_{x}" for x in ("direct", "inherited", "source", "owner", "latest_grant", "documents", "viewers_only", "mirror")]


@pytest.mark.parametrize("name", ["evidence_packet", *ACCESS, "continuation_merge"])
def test_whole_query(spark, sql, name):  # noqa: F811
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), sql.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_evidence_packet_reads_all_documents(spark):
    docs = {d for r in plans.QUERIES["evidence_packet"](spark, DATA).collect() for d in r.doc_ids}
    assert max(docs) >= 400


@pytest.mark.parametrize("tokens", [1, 40, 300])
def test_fill_equals_budget_of_interleaved(spark, tokens):
    r = spark.range(2000).select((F.col("id") % 3).alias("query_id"), (F.col("id") % 150).alias("doc_id"), F.col("id").cast("int").alias("chunk_number"), F.expr("repeat('x', int(id * 13 % 90))").alias("content"), F.md5(F.col("id").cast("string")).alias("rank"))
    keep = ["query_id", "doc_id", "chunk_number", "position", "used"]
    want = evidence.budget(evidence.cap_and_interleave(r), tokens).select(*keep).collect()
    assert sorted(want) == sorted(evidence.fill(r, tokens, parts=8).collect())


def test_grants_of_all_customers(spark):
    got = plans.QUERIES["access_latest_grant"](spark, DATA)
    assert got.agg(F.max("grant_id")).first()[0] == spark.read.parquet(f"{DATA}/customer.parquet").agg(F.max("c_custkey")).first()[0] > 300
    assert not any("c_custkey <= 300" in plans.ORACLES[name] for name in ACCESS)


def test_captions_of_long_conversations(spark, tmp_path):
    """Beyond turn 30, past a minute, an hour and a hundred hours."""
    turns = spark.range(2000).union(spark.range(180000, 180002)).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("said "), F.col("id")).alias("text"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["caption_rows"](spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.start_s, r.end_s, r.text) for r in got] == [(n, i * 2.0, i * 2 + 1.5, f"said {i}") for n, i in enumerate([*range(2000), 180000, 180001], 1)]
