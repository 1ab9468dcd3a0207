"""Tools as table functions of SQL: typed arguments that are checked when a query is analysed, errors as a column, folds over partitions of a table."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, NullType, NumericType, StringType, StructField, StructType, _parse_datatype_string

#: Types that an argument may have for each annotation (fixed values).
TAKES: dict[type, tuple[type[DataType], ...]] = {str: (StringType,), int: (IntegralType,), float: (NumericType,), bool: (BooleanType,), list: (ArrayType,)}
#: Characters of an error's text.
ERROR_CHARS = 200


class BadCall(ValueError):
    """A call that names no such argument, lacks one, or gives one of another type."""


def error_text(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:ERROR_CHARS]


def checked(f: Callable, given: tuple[AnalyzeArgument, ...], named: dict[str, AnalyzeArgument]) -> None:
    """Raises ``BadCall`` where the arguments of a call don't fit the function's annotations."""
    fields = list(inspect.signature(f, eval_str=True).parameters.values())
    if len(given) > len(fields):
        raise BadCall(f"{f.__name__}: {len(given)} arguments, takes {len(fields)}")
    known = dict(zip((p.name for p in fields), given))
    if unknown := sorted(set(named) - {p.name for p in fields}):
        raise BadCall(f"{f.__name__}: no argument {', '.join(unknown)}")
    known |= named
    if missing := [p.name for p in fields if p.default is p.empty and p.name not in known]:
        raise BadCall(f"{f.__name__}: missing {', '.join(missing)}")
    for p in fields:
        kinds = TAKES.get(p.annotation)
        if kinds is None:
            raise BadCall(f"{f.__name__}: no type for {p.name}")
        if p.name in known and not isinstance(known[p.name].dataType, (*kinds, NullType)):
            raise BadCall(f"{f.__name__}: {p.name} is {known[p.name].dataType.simpleString()}")


def table_function(f: Callable[..., Iterator[tuple]], columns: str):
    """A table function of ``f``, which yields rows of ``columns`` for its arguments; a last column ``error`` tells why a call gave none.

    A failed call is a row of nulls with its error. Rows given before the failure stay.
    """
    schema = StructType([*_parse_datatype_string(columns).fields, StructField("error", StringType())])
    width = len(schema.fields) - 1

    class Tool:
        @staticmethod
        def analyze(*given: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
            checked(f, given, named)
            return AnalyzeResult(schema)

        def eval(self, *given: Any, **named: Any) -> Iterator[tuple]:
            try:
                for row in f(*given, **named):
                    yield (*row, None)
            except Exception as e:  # noqa: BLE001  the row carries its error
                yield (*[None] * width, error_text(e))

    Tool.__doc__ = f.__doc__
    return udtf(Tool)


def fold_function(make: Callable[[], Any], columns: str, by: list[str], order: list[str]):
    """A table function over a table argument, dealt by ``by`` and ordered by ``order`` whatever the caller writes.

    ``make()`` gives an object for each partition whose ``step(row)`` yields rows and keeps what the next step needs: no
    partition is held as a whole. The result ends with ``error``; after an error its partition goes on with the next row.
    """
    schema = StructType([*_parse_datatype_string(columns).fields, StructField("error", StringType())])
    width = len(schema.fields) - 1

    class Fold:
        def __init__(self) -> None:
            self.state = make()

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise BadCall("takes TABLE(...)")
            have = {x.name for x in table.dataType.fields}
            if missing := [c for c in (*by, *order) if c not in have]:
                raise BadCall(f"the table lacks {', '.join(missing)}")
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order])

        def eval(self, row) -> Iterator[tuple]:
            try:
                for out in self.state.step(row):
                    yield (*out, None)
            except Exception as e:  # noqa: BLE001  the row carries its error
                yield (*[None] * width, error_text(e))

    return udtf(Fold)


def passages(text: str, size: int = 2048, overlap: int = 384) -> Iterator[tuple]:
    """Passages of a text: number, first and last place, content."""
    if size <= overlap or overlap < 0:
        raise ValueError("size must be above overlap, overlap not below 0")
    for n, start in enumerate(range(0, len(text or ""), size - overlap)):
        yield n, start, min(start + size, len(text)), text[start : start + size]


def matches(text: str, wanted: str, around: int = 40) -> Iterator[tuple]:
    """Places of a text where another stands, whatever the case: place and what is around it."""
    low, part = (text or "").lower(), wanted.lower()
    if not part:
        raise ValueError("nothing wanted")
    at = low.find(part)
    while at >= 0:
        yield at, text[max(0, at - around) : at + len(part) + around]
        at = low.find(part, at + len(part))


class RunningTokens:
    """Estimated tokens of a conversation up to each turn, and whether they are within the budget of its first turn's length times ten."""

    def __init__(self) -> None:
        self.used, self.most = 0, None

    def step(self, row) -> Iterator[tuple]:
        n = max(1, len(row["text"] or "") // 4)
        self.most = 10 * n if self.most is None else self.most
        self.used += n
        yield row["conv_id"], row["turn"], self.used, self.used <= self.most


#: Names under which SQL finds the tools.
TOOLS = {
    "tool_passages": lambda: table_function(passages, "chunk_number int, start_position int, end_position int, content string"),
    "tool_matches": lambda: table_function(matches, "place int, around string"),
    "tool_running_tokens": lambda: fold_function(RunningTokens, "conv_id bigint, turn bigint, used bigint, within boolean", ["conv_id"], ["turn"]),
}


def register(spark: SparkSession) -> None:
    """Makes all tools callable from SQL in this session, as in ``SELECT * FROM docs, LATERAL tool_passages(docs.text)``."""
    for name, make in TOOLS.items():
        spark.udtf.register(name, make())
