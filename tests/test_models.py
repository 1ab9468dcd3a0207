"""Plug-in points and the registry of table functions."""

from tessera import models


class Picky:
    def answer(self, inputs):
        if "bad" in inputs:
            raise ValueError("no")
        return [x.upper() for x in inputs]


def test_text_model_errors_are_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, input string").coalesce(1)
    got = {r.id: (r.answer, r.error) for r in models.apply_text(rows, Picky).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("C", None)}


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "aaaa"), (2, "a"), (3, "aa"), (4, "b")], "rank int, content string")
    assert [r["rank"] for r in models.rerank(rows, models.LengthReranker, "x", 2).collect()] == [2, 4]
    assert models.rerank(rows, models.LengthReranker, "x", 4).columns == rows.columns


def test_tools(spark):
    tools = models.Tools()

    @tools.add
    def numbers(spark, n: int, start: int = 0):
        """Numbers from ``start``."""
        return spark.range(start, start + n)

    assert tools.schema("numbers") == {"name": "numbers", "description": "Numbers from ``start``.", "properties": {"n": "integer", "start": "integer"}, "required": ["n"]}
    df, error = tools.call(spark, "numbers", n=3)
    assert error is None and df.count() == 3
    assert tools.call(spark, "numbers") == (None, "missing n")
    assert tools.call(spark, "other") == (None, "no tool other")
    assert tools.call(spark, "numbers", n="x")[1].startswith(("TypeError", "PySparkTypeError"))
