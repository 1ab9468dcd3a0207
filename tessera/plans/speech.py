"""Queries over what assistants write."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import speech as S
from tessera.functions import text as T
from tessera.functions import toolcalls as C
from tessera.plans.registry import query

#: Turns as an assistant may write them, by their length.
SAYS = """CASE length(text) % 11 WHEN 0 THEN concat('<think>', text, '</think>Final answer: ', text) WHEN 1 THEN 'Retrieving the paper...' WHEN 2 THEN concat('I', chr(39), 'll search ', substring(text, 1, 30)) WHEN 3 THEN concat(text, ' <tool_call>{"name": "x"}</tool_call>')
    WHEN 4 THEN 'Let me explain.' WHEN 5 THEN concat('Here is a concise summary from the retrieved document: ', text) WHEN 6 THEN concat('<think>open ', text) WHEN 7 THEN concat('[doc:a1 chunk:3] ', substring(text, 1, 40), ' ![a](b.png)') WHEN 8 THEN concat('Tool: vector_search', chr(10), text)
    WHEN 9 THEN concat('I will check ![fig](', substring(text, 1, 5)) ELSE text END"""


def says(t):
    return t("conversations").select("conv_id", "turn", F.expr(SAYS).alias("t"))


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '" + pattern.replace("'", "''") + "')"


def among(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + p.replace("'", "''") + "')" for p in parts) + ")"


#: Columns of the SQL: th (without reasoning), s (stripped), b (without tools too), low forms and word counts.
SEEN = rf"""y AS (SELECT conv_id, turn, {SAYS} AS t FROM conversations), th AS (SELECT *, regexp_replace(regexp_replace(t, '{S.THINK}', '', 'g'), '{S.OPEN_THINK}', '') AS th FROM y),
    s AS (SELECT *, regexp_replace(th, '^\s+|\s+$', '', 'g') AS s, regexp_replace(regexp_replace(th, '{S.TOOL_BLOCK}', '', 'g'), '{S.TOOL_OPEN}', '', 'g') AS nt FROM th),
    b AS (SELECT *, regexp_replace(nt, '^\s+|\s+$', '', 'g') AS b, replace(replace(lower(s), '‘', ''''), '’', '''') AS low, replace(replace(lower(t), '‘', ''''), '’', '''') AS tlow, len(regexp_extract_all(s, '[A-Za-z0-9]+')) AS n FROM s),
    f AS (SELECT *, {among('lower(s)', S.TOOL_TAGS)} OR {has('s', S.TRANSCRIPT)} OR {among('low', S.SEARCH_CUES)} OR {has('low', S.SEARCH_PLAN)} AS deferred,
        {among('lower(t)', S.TOOL_TAGS)} OR {has('t', S.TRANSCRIPT)} OR {among('tlow', S.SEARCH_CUES)} OR {has('tlow', S.SEARCH_PLAN)} AS tdeferred, trim(regexp_replace(tlow, '\s+', ' ', 'g')) AS one FROM b),
    i AS (SELECT *, s <> '' AND ((n <= 18 AND ({has('s', S.STATUS)} OR (n < 15 AND (ends_with(s, '...') OR ends_with(s, '…'))))) OR {has('b', S.BARE_TOOL)} OR {' OR '.join(f"starts_with(lower(b), '{d}')" for d in S.DUMP_STARTS)} OR deferred) AS interim FROM f)"""


@query("answer_visibility", f"""WITH {SEEN} SELECT conv_id, turn, interim, s <> '' AND NOT interim AND n >= 2 AS displayable, tdeferred AS deferred,
    tdeferred OR (one <> '' AND len(regexp_extract_all(one, '[a-z0-9]+')) <= 18 AND len(regexp_extract_all(one, '[.!?]')) <= 1 AND {has('one', '|'.join(S.PROMISES))}) AS non_answer, md5(th) AS unthought FROM i""")
def answer_visibility(t):
    x = F.col("t")
    return says(t).select("conv_id", "turn", S.interim(x).alias("interim"), S.displayable(x).alias("displayable"), S.deferred(x).alias("deferred"), S.non_answer(x).alias("non_answer"), F.md5(S.without_thinking(x)).alias("unthought"))


@query("image_markdown", r"""SELECT conv_id, turn, regexp_matches(t, '!\[[^\]]*\]\([^)]+\)') AS shows, regexp_matches(t, '!\[[^\]]*\]\([^)]*$') AS open, %s AS asks FROM (SELECT conv_id, turn, %s AS t FROM conversations)""" % (among("lower(t)", S.SHOW_CUES), SAYS))
def image_markdown(t):
    x = F.col("t")
    return says(t).select("conv_id", "turn", S.has_image(x).alias("shows"), S.open_image(x).alias("open"), S.asks_for_image(x).alias("asks"))


#: Arguments of calls under one of several names, by document.
NAMES = ("query", "keyword", "search_string", "k", "top_k", "citation", "documentId", "chunk")
RAW = "concat('{\"', CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END, '\":\"', CASE WHEN doc_id % 8 IN (3, 4, 7) THEN concat(cast(doc_id % 13 AS VARCHAR(9)), '.7') WHEN doc_id % 8 = 5 THEN concat('[doc:', source, ' chunk:', cast(doc_id AS VARCHAR(9)), ']') ELSE concat(' ', source) END, '\"}')"
TOOL = "CASE doc_id % 3 WHEN 0 THEN 'vector_search' WHEN 1 THEN 'search_single_document' ELSE 'more_context' END"


@query("call_arguments", f"""WITH r AS (SELECT doc_id, {TOOL} AS tool, {RAW} AS raw FROM documents), g AS (SELECT *, {', '.join(f"json_extract_string(raw, '$.{n}') AS {n.lower()}" for n in NAMES)} FROM r),
    c AS (SELECT *, CAST(trunc(TRY_CAST(coalesce(top_k, k) AS DOUBLE)) AS BIGINT) AS top, CAST(trunc(TRY_CAST(chunk AS DOUBLE)) AS BIGINT) AS ch, CAST(trunc(TRY_CAST(coalesce(k, top_k) AS DOUBLE)) AS BIGINT) AS adj FROM g)
    SELECT doc_id, CASE WHEN tool <> 'more_context' THEN coalesce(search_string, query, keyword) END AS search_string, CASE tool WHEN 'vector_search' THEN coalesce(CAST(top AS VARCHAR), '10') WHEN 'search_single_document' THEN CAST(top AS VARCHAR) END AS top_k,
    CASE WHEN tool = 'search_single_document' THEN coalesce(trim(documentid), nullif(regexp_extract(citation, '\\[doc:([^\\]\\s]+)', 1), '')) END AS ref, CASE WHEN tool = 'more_context' THEN coalesce(CAST(ch AS VARCHAR), nullif(regexp_extract(citation, 'chunk:([0-9]+)', 1), '')) END AS chunk_id,
    CASE WHEN tool = 'more_context' THEN CAST(adj AS VARCHAR) END AS adjacent_chunks FROM c""")
def call_arguments(t):
    rows = t("documents").select("doc_id", F.expr(TOOL).alias("tool"), F.from_json(F.expr(RAW), "map<string,string>").alias("raw"))
    a = C.arguments(F.col("tool"), F.col("raw"))
    return rows.select("doc_id", a["search_string"].alias("search_string"), a["top_k"].alias("top_k"), a["doc_id"].alias("ref"), a["chunk_id"].alias("chunk_id"), a["adjacent_chunks"].alias("adjacent_chunks"))


#: Prose with a call in it: fenced, tagged, tagged by the tool's name, unknown, none.
PROSE = """CASE doc_id % 5 WHEN 0 THEN concat('Sure.', chr(10), '```json', chr(10), '{"name": "vector_search", "arguments": {"q": "', source, '"}}', chr(10), '```') WHEN 1 THEN concat('<tool_call>{"tool_name": "whole_document", "args": {"q": "', source, '"}}</tool_call>')
    WHEN 2 THEN concat('so <vector_search>{"q": "', source, '"}</vector_search>') WHEN 3 THEN concat('{"name": "unknown", "arguments": {"q": "', source, '"}}') ELSE concat('none here: ', source) END"""


@query("tool_call_recovery", f"""SELECT doc_id, CASE WHEN contains(t, 'vector_search') THEN 'vector_search' ELSE 'whole_document' END AS name, json_extract_string(regexp_extract(t, '[{{]"q": "[^"]*"[}}]'), '$.q') AS q FROM (SELECT doc_id, {PROSE} AS t FROM documents)
    WHERE contains(t, 'vector_search') OR contains(t, 'whole_document')""")
def tool_call_recovery(t):
    rows = t("documents").select("doc_id", C.call(F.expr(PROSE), ("vector_search", "whole_document")).alias("c")).where("c IS NOT NULL")
    return rows.select("doc_id", "c.name", F.get_json_object("c.arguments", "$.q").alias("q"))


@query("first_json_object", r"""SELECT doc_id, '{"a": {"b": "' || source || '}"}, "n": ' || doc_id || '}' AS found FROM documents WHERE doc_id % 4 <> 0""")
def first_json_object(t):
    raw = F.expr("""concat('see } ', CASE WHEN doc_id % 4 = 0 THEN '{"open": "' ELSE concat('{"a": {"b": "', source, '}"}, "n": ', doc_id, '} and {"c": 1}') END)""")
    return t("documents").select("doc_id", C.json_object_at(raw).alias("found")).where("found IS NOT NULL")


@query("overflow_tokens", """SELECT doc_id, CASE WHEN doc_id % 4 < 3 AND doc_id % 7 > 0 THEN CAST(doc_id % 7 AS BIGINT) END AS n FROM documents""")
def overflow_tokens(t):
    said = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('passed 1,', cast(200 + doc_id % 7 AS STRING), ' input tokens; the maximum input length of 1_200 tokens') WHEN 1 THEN concat('maximum context length is 800 tokens, you requested ', cast(800 + doc_id % 7 AS STRING), ' tokens')
        WHEN 2 THEN concat('Requested ', cast(9000 + doc_id % 7 AS STRING), ' tokens, maximum context length is 9,000 tokens') ELSE 'server error' END""")
    return t("documents").select("doc_id", C.overflow(said).alias("n"))


@query("caption_display", r"""WITH c AS (SELECT doc_id, trim(replace(CASE doc_id % 5 WHEN 0 THEN 'Figure ' || doc_id WHEN 1 THEN 'untitled' WHEN 2 THEN substring(text, 1, 40) WHEN 3 THEN '##$$ %% ' || source ELSE '12 ..' END, chr(10), ' '), ' ' || chr(9) || chr(13)) AS c FROM documents)
    SELECT doc_id, lower(c) NOT IN ('', 'figure', 'image', 'untitled') AND (regexp_matches(c, '(?i)^(figure|fig\.?)\s*\d+[A-Za-z0-9.-]*$') OR (len(regexp_extract_all(c, '[^\w\s]')) <= greatest(3, length(c) // 6) AND len(regexp_extract_all(c, '[A-Za-z]')) >= 3 AND length(c) <= 120)) AS shown FROM c""")
def caption_display(t):
    c = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Figure ' || doc_id WHEN 1 THEN 'untitled' WHEN 2 THEN substring(text, 1, 40) WHEN 3 THEN '##$$ %% ' || source ELSE '12 ..' END")
    return t("documents").select("doc_id", S.caption_shown(c, T.useful_sentence(c)).alias("shown"))


@query("overflow_retries", """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 97 + 1 END AS o, event_id % 1500 AS m, event_id % 2 = 0 AS t, event_id % 3 = 0 AS i FROM events), k AS (SELECT *, CASE WHEN t THEN 128 ELSE 384 END AS k, CASE WHEN t THEN 64 ELSE 192 END AS f FROM e)
    SELECT event_id, CAST(CASE WHEN o IS NULL THEN NULL WHEN m > k THEN greatest(k, m - o - CASE WHEN o <= 4 THEN 8 ELSE greatest(32, least(192, o * 4)) END) WHEN NOT i AND m > f THEN greatest(f, m - o - greatest(16, least(128, o * 4))) ELSE m END AS BIGINT) AS max_tokens,
    CASE event_id % 4 WHEN 0 THEN 'see' || chr(10) || '[Image removed due to context limit]' WHEN 1 THEN '[Image removed due to context limit]' END AS text FROM k""")
def overflow_retries(t):
    """Overflows of many sizes, with and without tools; messages with an image beside text, of an image, of text, and with a part of another kind."""
    i = F.col("event_id")
    parts = F.from_json(F.expr("""CASE event_id % 4 WHEN 0 THEN '[{"type": "text", "text": "see"}, {"type": "image_url"}]' WHEN 1 THEN '[{"type": "input_image"}]' WHEN 2 THEN '[{"type": "text", "text": "only"}]' ELSE '[{"type": "image"}, {"type": "audio"}]' END"""), "array<struct<type:string,text:string>>")
    return t("events").select("event_id", C.retry_tokens(F.when(i % 11 > 0, i % 97 + 1), i % 1500, i % 2 == 0, i % 3 == 0).alias("max_tokens"), C.without_images(parts).alias("text"))
