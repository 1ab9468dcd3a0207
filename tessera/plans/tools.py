"""Queries that call tools from SQL."""

from __future__ import annotations

from tessera import tools
from tessera.plans.corpus import CHUNKS
from tessera.plans.registry import query


def called(t, name: str, sql: str):
    """``sql`` over a table under its name, with the tools at hand."""
    rows = t(name)
    tools.register(rows.sparkSession)
    rows.createOrReplaceTempView(f"tools_{name}")
    return rows.sparkSession.sql(sql)


@query("tool_passages", CHUNKS)
def tool_passages(t):
    """Passages of every document by a lateral join."""
    return called(t, "documents", "SELECT d.doc_id, p.chunk_number, p.start_position, p.end_position, p.content FROM tools_documents d, LATERAL tool_passages(d.text) p WHERE p.error IS NULL")


@query("tool_errors", "SELECT item_id, CAST(NULL AS INTEGER) AS place, 'ValueError: nothing wanted' AS error FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 0, NULL FROM benchmark WHERE item_id % 2 = 1 AND length(text) > 0")
def tool_errors(t):
    """A tool that fails for every second row, whose own text is found once in itself for the others."""
    return called(t, "benchmark", "SELECT b.item_id, m.place, m.error FROM tools_benchmark b, LATERAL tool_matches(b.text, wanted => CASE WHEN b.item_id % 2 = 0 THEN '' ELSE b.text END) m")


@query("tool_running_tokens", """WITH u AS (SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER w AS used, first_value(10 * greatest(1, length(text) // 4)) OVER w AS most FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, CAST(used AS BIGINT) AS used, used <= most AS within FROM u""")
def tool_running_tokens(t):
    """A fold over conversations, dealt and ordered by the tool itself."""
    return called(t, "conversations", "SELECT conv_id, turn, used, within FROM tool_running_tokens(TABLE(tools_conversations))")
