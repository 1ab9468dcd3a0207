"""Answers of a reranking service, and its use on a query's candidates."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a candidate that are sent; what an answer may hold.
SENT_CHARS = 2000
ANSWER = "struct<results:array<struct<index:string,score:string,relevance_score:string>>,data:array<struct<index:string,score:string,relevance_score:string>>,score:string>"


def _items(body: Column) -> Column:
    got = F.from_json(body, ANSWER)
    return F.coalesce(got["results"], got["data"], F.array().cast("array<struct<index:string,score:string,relevance_score:string>>"))


def order(body: Column, n: Column) -> Column:
    """Places of candidates (from 0, of ``n``) in the order of a service's answer; indexes that aren't whole, are out of range or come again are skipped."""
    index = F.transform(_items(body), lambda x: F.when(x["index"].rlike("^-?[0-9]+$"), x["index"].try_cast("int")))
    return F.array_distinct(F.filter(index, lambda i: i.isNotNull() & (i >= 0) & (i < n)))


def scores(body: Column) -> Column:
    """Pairs of index and score of an answer that scores; the score is ``score``, else ``relevance_score``; others are skipped."""
    got = F.from_json(body, ANSWER)
    items = F.coalesce(got["data"], got["results"], F.array().cast("array<struct<index:string,score:string,relevance_score:string>>"))
    pairs = F.transform(items, lambda x: F.struct(F.when(x["index"].rlike("^-?[0-9]+$"), x["index"].try_cast("int")).alias("index"), F.coalesce(x["score"].try_cast("double"), x["relevance_score"].try_cast("double")).alias("score")))
    return F.filter(pairs, lambda p: p["index"].isNotNull() & p["score"].isNotNull())


def single_score(body: Column) -> Column:
    """The score of an answer on one pair: a bare number, ``score``, or that of its first item; null otherwise."""
    first = F.get(_items(body), F.lit(0))
    return F.coalesce(F.trim(body).try_cast("double"), F.get_json_object(body, "$.score").try_cast("double"), first["score"].try_cast("double"), first["relevance_score"].try_cast("double"))


def by_service(candidates: DataFrame, query: str, top_k: int, call: Callable[[str], str]) -> DataFrame:
    """A query's candidates (rank, content; the bounded union of its search's legs) in the order of a service's answer.

    ``call`` takes the request as JSON and gives the answer as JSON. Candidates that it
    leaves out go; if it fails or names none, the order of the candidates stands.
    """
    rows = candidates.orderBy("rank").collect()
    spark = candidates.sparkSession
    request = json.dumps({"query": query, "documents": [r["content"][:SENT_CHARS] for r in rows], "top_n": top_k}, ensure_ascii=False)
    try:
        answer = call(request)
        places = spark.createDataFrame([(answer, len(rows))], "b string, n int").select(order(F.col("b"), F.col("n"))).first()[0] if rows else []
    except Exception:  # noqa: BLE001  a service that fails leaves the order as it is
        places = []
    kept = [rows[i] for i in places] if places else rows
    fields = [c for c in candidates.columns if c != "rank"]
    out = [(k, *(r[c] for c in fields)) for k, r in enumerate(kept[:top_k], 1)]
    return spark.createDataFrame(out, ", ".join(["rank int", *(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema if f.name != "rank")]))
