"""Offline evaluation of retrieval turns: what should have happened, what did, and the tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.conversation import intent

#: Reasons for which documents are searched.
SEARCHES = ("explicit_search", "figure_request", "collection_backed_question", "retry_request")
ASK_FOR_COLLECTION = "Select a collection to search first."


def no_results(message: Column) -> Column:
    """What a search that found nothing says."""
    return F.concat(F.lit('I searched the selected documents for "'), message, F.lit('", but retrieval returned no relevant passages.'))


def run(cases: DataFrame) -> DataFrame:
    """Outcome, search and answer of each case: id, outcome, searched, content.

    ``cases``: id, message, collection_ids, status and answer of a stand-in for retrieval and model.
    """
    chosen = F.size("collection_ids") > 0
    wanted = F.when(chosen, intent(F.col("message"), True)).otherwise(intent(F.col("message"), False)).isin(*SEARCHES)
    content = F.when(~wanted, "").when(~chosen, ASK_FOR_COLLECTION).when(F.col("status") == "no_results", no_results(F.col("message"))).otherwise(F.col("answer"))
    return cases.select("id", F.when(wanted, "handled").otherwise("skipped").alias("outcome"), (wanted & chosen).alias("searched"), content.alias("content"))


def check(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Failures of each case (expected: id, expect_outcome, expect_searched, expect_contains): id, passed, failures."""
    rows = expected.join(results, "id", "left")
    missing = F.filter("expect_contains", lambda x: ~F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lower(x)))
    failures = F.concat(
        F.when(F.col("outcome").eqNullSafe(F.col("expect_outcome")), F.array().cast("array<string>")).otherwise(F.array(F.lit("outcome"))),
        F.when(F.col("searched").eqNullSafe(F.col("expect_searched")), F.array().cast("array<string>")).otherwise(F.array(F.lit("searched"))),
        F.transform(missing, lambda x: F.concat(F.lit("content missing "), x)),
    )
    return rows.select("id", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def tally(checks: DataFrame) -> DataFrame:
    """How many cases passed and failed."""
    return checks.agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
