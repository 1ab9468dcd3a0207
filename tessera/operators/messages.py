"""Messages as rows of one table and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import speech as S

COMMON = ("conv_id", "message_uuid", "role", "content", "rating", "feedback_text")
ASSISTANT = ("model", "stop_reason", "tool_call_id", "tool_call_name", "tool_call_input", "usage")
TOOL = ("tool_name", "arguments", "for_whom", "result_dict")


def to_rows(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, and fields of any role) as rows: sequence_number for turn, an assistant's content as it is shown, fields of other roles null."""
    have = set(messages.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    content = F.when(F.col("role") == "assistant", S.shown(F.col("content"))).otherwise(F.col("content"))
    own = lambda names, role: [F.when(F.col("role") == role, get(c)).alias(c) for c in names]
    return messages.select(*(content.alias(c) if c == "content" else get(c).alias(c) for c in COMMON), F.col("turn").alias("sequence_number"), *own(ASSISTANT, "assistant"), *own(TOOL, "tool"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Each conversation's messages in order: conv_id, messages (structs); a missing stop reason is ``end_turn``, a tool's missing fields are empty or for the assistant."""
    default = {"stop_reason": ("assistant", "end_turn"), "tool_name": ("tool", ""), "for_whom": ("tool", "assistant"), "result_dict": ("tool", "{}")}
    fields = [F.when(F.col("role") == default[c][0], F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default[c][1]))).alias(c) if c in default else F.col(c) for c in (*COMMON[1:], *ASSISTANT, *TOOL)]
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("sequence_number", *fields))).alias("messages"))
