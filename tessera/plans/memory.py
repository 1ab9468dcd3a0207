"""Queries over memories and profile facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import conversation as C
from tessera.operators import memory as M
from tessera.plans.conversations import CATEGORY, HEURISTIC, SAID
from tessera.plans.registry import query

#: Items of an external store: the turns of a conversation as its results, some of another owner or of none, under several names.
ITEM = """concat('{"', CASE turn % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'text' WHEN 2 THEN 'other' ELSE 'value' END, '":" ', role, ' ', CAST(length(text) AS VARCHAR(9)), '","', CASE WHEN length(text) % 3 = 0 THEN 'owner' ELSE 'user_id' END, '":"u', CAST(length(text) % 2 AS VARCHAR(9)), '","metadata":{"conversation_id":"', CAST(turn AS VARCHAR(9)), '"}}')"""


@query("memory_items", f"""WITH i AS (SELECT conv_id AS search_id, turn, {ITEM} AS item FROM conversations), c AS (SELECT search_id, turn, coalesce(nullif(trim(json_extract_string(item, '$.memory')), ''), nullif(trim(json_extract_string(item, '$.text')), ''), nullif(trim(json_extract_string(item, '$.value')), ''), trim(item)) AS content, turn AS conversation_id
    FROM i WHERE json_extract_string(item, '$.user_id') = 'u1' AND turn <> 2) SELECT search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY turn) AS INTEGER) AS place, content, CAST(conversation_id AS BIGINT) AS conversation_id FROM c QUALIFY place <= 3""")
def memory_items(t):
    items = t("conversations").select(F.col("conv_id").alias("search_id"), F.col("turn").alias("place"), F.expr(ITEM.replace("VARCHAR(9)", "STRING")).alias("item"), F.lit("u1").alias("user_id"), F.lit(2).cast("long").alias("exclude"))
    return M.parse_items(items, 3)


#: A memory with what retrieval leaves in it.
LEFT = "concat('[Result 3] of ', role, chr(10), 'chunk_id: 12 ', text, ' chunk #: 7 Arguments: x ', role, ' Results:y')"


@query("memory_line", r"""SELECT conv_id, turn, CASE WHEN length(l) > 240 THEN rtrim(substring(l, 1, 240)) || '...' ELSE l END AS line FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)\[Result\s+\d+\][^\n]*', ' ', 'g'), '(?i)\bchunk_id\s*:?\s*\d+\b', ' ', 'g'), '(?i)\bchunk\s*#\s*:?\s*\d+\b', ' ', 'g'), '(?is)\bArguments:\s*.*?\bResults:\b', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS l
    FROM (SELECT conv_id, turn, %s AS m FROM conversations))""" % LEFT)
def memory_line(t):
    return t("conversations").select("conv_id", "turn", M.line(F.expr(LEFT)).alias("line"))


FACTS = M.FACTS_HEAD.replace("'", "''")
EPISODES = M.EPISODES_HEAD.replace("'", "''")


@query("memory_block", f"""WITH f AS (SELECT user_id, string_agg(chr(10) || '  - ' || fact, '' ORDER BY category, made, fact) AS f FROM (SELECT DISTINCT c_custkey % 30 AS user_id, c_mktsegment AS category, c_custkey AS made, c_name AS fact FROM customer WHERE c_custkey % 30 < 20) GROUP BY user_id),
    e AS (SELECT user_id, string_agg(chr(10) || '  - ' || m, '' ORDER BY place, m) AS e FROM (SELECT s_suppkey % 30 AS user_id, s_suppkey AS place, s_name AS m FROM supplier WHERE s_suppkey % 30 > 10) GROUP BY user_id)
    SELECT user_id, md5(coalesce(chr(10) || chr(10) || '{FACTS}' || f, '') || coalesce(chr(10) || chr(10) || '{EPISODES}' || e, '')) AS block FROM f FULL JOIN e USING (user_id)""")
def memory_block(t):
    facts = t("customer").where("c_custkey % 30 < 20").select((F.col("c_custkey") % 30).alias("user_id"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("fact"), F.col("c_custkey").alias("created_at"))
    episodes = t("supplier").where("s_suppkey % 30 > 10").select((F.col("s_suppkey") % 30).alias("user_id"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("content"))
    return M.block(facts, episodes).select("user_id", F.md5("block").alias("block"))


PAIRS = """SELECT conv_id, turn, 'User: ' || substring(asked, 1, 500) || chr(10) || 'Assistant: ' || substring(text, 1, 500) AS memory FROM (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS asked FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'"""


@query("memory_write", f"SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'old' ELSE memory END AS memory FROM ({PAIRS})")
def memory_write(t):
    pairs = C.pairs(t("conversations"))
    return M.write(pairs.where("conv_id % 3 = 0").withColumn("memory", F.lit("old")), pairs)


@query("fact_promotion", f"""WITH {HEURISTIC}, n AS (SELECT DISTINCT conv_id % 20 AS user_id, fact FROM k), o AS (SELECT DISTINCT user_id, fact FROM n WHERE length(fact) % 2 = 0)
    SELECT n.user_id, n.fact, CASE WHEN o.fact IS NOT NULL THEN 'kept' ELSE {CATEGORY.format('n.fact')} END AS category FROM n LEFT JOIN o ON o.user_id = n.user_id AND o.fact = n.fact""")
def fact_promotion(t):
    turns = t("conversations").where("role = 'user'").select((F.col("conv_id") % 20).alias("user_id"), F.expr(SAID).alias("text"))
    none = turns.sparkSession.createDataFrame([], "user_id long, fact string, category string")
    known = M.promote(none, turns).where("length(fact) % 2 = 0").withColumn("category", F.lit("kept"))
    return M.promote(known, turns)
