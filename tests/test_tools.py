"""Tools as table functions."""

import pytest

from tessera import tools


@pytest.fixture(scope="module")
def sql(spark):
    tools.register(spark)
    return lambda text: [tuple(r) for r in spark.sql(text).collect()]


def test_lateral_calls_and_errors(sql):
    assert sql("SELECT * FROM tool_passages('abcdef', 4, 1)") == [(0, 0, 4, "abcd", None), (1, 3, 6, "def", None)]
    assert sql("SELECT * FROM tool_passages(NULL)") == []
    assert sql("SELECT error FROM tool_passages('abc', size => 1, overlap => 1)") == [("ValueError: size must be above overlap, overlap not below 0",)]
    rows = "VALUES (1, 'one One'), (2, NULL), (3, 'two') AS t(id, text)"
    assert sorted(sql(f"SELECT id, place, error FROM (SELECT * FROM {rows}) d, LATERAL tool_matches(d.text, 'one')")) == [(1, 0, None), (1, 4, None)]


@pytest.mark.parametrize(("call", "said"), [("tool_matches('a')", "missing wanted"), ("tool_matches('a', 5)", "wanted is int"), ("tool_matches('a', 'b', much => 1)", "no argument much"), ("tool_matches('a', 'b', 1, 2)", "4 arguments"), ("tool_running_tokens(TABLE(SELECT 1 AS conv_id))", "lacks turn")])
def test_bad_calls_fail_when_analysed(spark, sql, call, said):
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM {call}").schema


def test_folds_are_dealt_and_ordered_by_the_tool(sql):
    rows = "SELECT * FROM VALUES (2, 1, 'x'), (1, 2, repeat('a', 400)), (1, 1, 'bbbbbbbb'), (2, 2, NULL) AS t(conv_id, turn, text)"
    assert sorted(sql(f"SELECT conv_id, turn, used, within, error FROM tool_running_tokens(TABLE({rows}))")) == [(1, 1, 2, True, None), (1, 2, 102, False, None), (2, 1, 1, True, None), (2, 2, 2, True, None)]


class Odd:
    def step(self, row):
        if row["n"] % 2:
            raise RuntimeError(f"odd {row['n']}")
        yield (row["n"],)


def test_a_fold_goes_on_after_an_error(spark, sql):
    spark.udtf.register("tool_odd", tools.fold_function(Odd, "n int", ["g"], ["n"]))
    assert sorted(sql("SELECT * FROM tool_odd(TABLE(SELECT * FROM VALUES (1, 1), (1, 2), (1, 3) AS t(g, n)))"), key=str) == [(2, None), (None, "RuntimeError: odd 1"), (None, "RuntimeError: odd 3")]
