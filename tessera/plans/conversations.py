"""Queries over conversations, feedback and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conversation as C
from tessera.operators import continuation, graph
from tessera.plans.registry import query
from tessera.plans.rules import squeezed
from tessera.shared import spread
from tessera.sources import sinks


def sql_word(p: str) -> str:
    return f"regexp_matches(text, '{C.whole_word(p)}')"


def rated(t):
    """Messages with ratings taken from labels and a timestamp from their place."""
    m = t("conversations").join(t("labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic"), "conv_id", "left")
    return m.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.col("quality") + 1).alias("rating"), F.when(F.col("toxic") == 1, " ").alias("feedback_text"), F.expr("timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60)").alias("ts"))


RATED = """SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' THEN quality + 1 END AS rating, CASE WHEN toxic = 1 THEN ' ' END AS feedback_text,
    make_timestamp((1704067200 + c.conv_id * 3600 + turn * 60) * 1000000) AS ts FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id"""


@query("question_numbers", "SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_number FROM conversations")
def question_numbers(t):
    return C.question_numbers(t("conversations"))


@query("memory_pairs", """WITH m AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS asked FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 'User: ' || substring(asked, 1, 500) || chr(10) || 'Assistant: ' || substring(text, 1, 500) AS memory FROM m WHERE role = 'assistant' AND before = 'user'""")
def memory_pairs(t):
    return C.pairs(t("conversations"))


@query("memory_anti_join", """WITH m AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role IN ('user', 'assistant') AND text <> '')
    SELECT conv_id, turn FROM m WHERE role = 'assistant' AND before = 'user' AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = conv_id)""")
def memory_anti_join(t):
    return C.pairs(t("conversations")).join(t("labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti").select("conv_id", "turn")


@query("last_user_message", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(t):
    return C.last_user(t("conversations"))


@query("conversation_titles", f"""WITH f AS (SELECT conv_id, trim(trim(trim(trim({squeezed("arg_min(text, turn)")}, '"'), chr(39)), '*')) AS s FROM conversations WHERE role = 'user' GROUP BY conv_id),
    w AS (SELECT conv_id, string_split(trim(s, '.,:;!?- '), ' ') AS w FROM f), t AS (SELECT conv_id, array_to_string(w[1:8], ' ') || CASE WHEN len(w) > 8 THEN '...' ELSE '' END AS t FROM w)
    SELECT conv_id, CASE WHEN t = '' THEN 'Conversation' ELSE upper(t[1]) || t[2:] END AS title FROM t""")
def conversation_titles(t):
    return C.titles(t("conversations"))


#: Every third turn of a user holds a tool's result.
RESULTS = "SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 3 = 2 THEN concat('Tool vector_search result: ', text) ELSE text END AS text FROM conversations"


@query("message_salience", "WITH m AS (" + RESULTS + r"""), l AS (SELECT conv_id, trim(arg_max(text, turn)) AS q FROM m WHERE role = 'user' AND NOT starts_with(text, 'Tool vector_search result:') GROUP BY conv_id HAVING q <> ''),
    w AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(q), '[^a-z]+'), lambda x: length(x) >= 3)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) AS b,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM m JOIN l USING (conv_id))
    SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / greatest(1, sqrt(len(a)) * sqrt(len(b))) ELSE 0 END + CAST(regexp_matches(text, '\[[0-9]+\]') AS INTEGER) * 0.15
        + CAST(regexp_matches(text, '(^|[^A-Za-z0-9_])10\.[0-9]{4,}/[^ \t\r\n]') OR contains(lower(text), 'doi:') AS INTEGER) * 0.2 + CAST(regexp_matches(text, '(^|[^A-Za-z0-9_])(19|20)[0-9]{2}([^A-Za-z0-9_]|$)') AS INTEGER) * 0.05 + i / n * 0.02, 6) AS salience FROM w""")
def message_salience(t):
    said = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 2), F.concat(F.lit("Tool vector_search result: "), "text")).otherwise(F.col("text"))
    return C.salience(t("conversations").select("conv_id", "turn", "role", said.alias("text")))


@query("turn_groups", "SELECT conv_id, turn, role, CAST(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM conversations")
def turn_groups(t):
    return C.groups_after_assistant(t("conversations"))


@query("pinned_turns", """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, min(turn) AS f FROM u WHERE b <= 2 GROUP BY conv_id)
    SELECT conv_id, turn, coalesce(turn >= f, false) AS pinned FROM conversations LEFT JOIN f USING (conv_id)""")
def pinned_turns(t):
    return C.pinned(t("conversations"))


@query("context_eviction", """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, min(turn) AS f FROM u WHERE b <= 2 GROUP BY conv_id),
    m AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens, length(text) % 7 AS salience, coalesce(turn >= f, false) AS pinned FROM conversations LEFT JOIN f USING (conv_id)),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pinned, salience, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb FROM m)
    SELECT conv_id, turn, pinned OR lb <= 200 AS kept FROM r""")
def context_eviction(t):
    m = t("conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"), (F.length("text") % 7).alias("salience"))
    return C.evict(m.join(C.pinned(t("conversations")), ["conv_id", "turn"]), 200)


@query("chat_intent", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i){C.RETRY}') THEN 'retry_request' WHEN {sql_word(C.LOCAL)} THEN 'local_tool_request' WHEN {sql_word(C.FIGURE_TARGET)} AND {sql_word(C.FIGURE_ACTION)} THEN 'figure_request'
    WHEN {sql_word(C.DOC_TARGET)} AND {sql_word(C.DOC_ACTION)} THEN 'explicit_search' WHEN list_bool_or(list_transform({list(C.DOC_CUES)}, lambda w: contains(lower(text), w))) AND list_bool_or(list_transform({list(C.QUESTION_CUES)}, lambda w: contains(lower(text), w)))
    THEN 'collection_backed_question' ELSE 'no_retrieval_needed' END AS reason FROM conversations""")
def chat_intent(t):
    return t("conversations").select("conv_id", "turn", C.intent(F.col("text"), True).alias("reason"))


@query("feedback_export", f"""WITH m AS ({RATED}), n AS (SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_number FROM conversations)
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, conv_id, question_number, rating, feedback_text FROM m JOIN n USING (conv_id, turn) WHERE (rating IS NOT NULL OR feedback_text <> '') AND ts <= TIMESTAMP '2024-01-05 23:59:59.999999'""")
def feedback_export(t):
    rows = C.feedback(rated(t), start="not a date", end="2024-01-05")
    n = C.question_numbers(t("conversations")).drop("role")
    return rows.join(n, ["conv_id", "turn"]).select(T.iso_utc(F.col("ts")).alias("date"), "conv_id", "question_number", "rating", "feedback_text")


@query("feedback_validation", "SELECT event_id, CASE WHEN CAST(floor(value) AS BIGINT) % 8 BETWEEN 1 AND 5 THEN CAST(floor(value) AS INTEGER) % 8 END AS rating, nullif(substring(trim('  ' || event_type), 1, 10000), '') AS feedback_text FROM events" )
def feedback_validation(t):
    return t("events").select("event_id", C.valid_rating((F.floor("value") % 8).cast("string")).alias("rating"), C.valid_feedback(F.concat(F.lit("  "), F.col("event_type"))).alias("feedback_text"))


#: Tool calls: each turn as a call of the tool its role names, with results that now and then repeat, fail or are missing.
CALLS = """SELECT conv_id, turn, role AS tool_name, CAST(length(text) % 3 AS VARCHAR) AS signature, CASE WHEN length(text) % 4 > 0 THEN CAST(length(text) % 5 AS VARCHAR) END AS result, length(text) % 7 = 0 AS failed FROM conversations"""


def calls(t):
    n = F.length("text")
    return t("conversations").select("conv_id", "turn", F.col("role").alias("tool_name"), (n % 3).cast("string").alias("signature"), F.when(n % 4 > 0, (n % 5).cast("string")).alias("result"), (n % 7 == 0).alias("failed"))


@query("retrieval_queries", f"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 5 = 0 THEN ' Try again. ' ELSE text END AS text, CASE WHEN role <> 'user' AND length(text) % 2 = 0 THEN role || turn END AS q, CASE WHEN role <> 'user' AND length(text) % 2 = 0 AND turn % 3 < 2 THEN 'T' || turn END AS t FROM conversations),
    l AS (SELECT *, last_value(q IGNORE NULLS) OVER w AS lq, last_value(t IGNORE NULLS) OVER w AS lt, trim(text) AS p FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, CASE WHEN regexp_matches(p, '(?i){C.RETRY}') THEN coalesce(lq, p) WHEN len(list_intersect(regexp_split_to_array(lower(p), '[^\\p{{L}}\\p{{N}}_]+'), {list(C.PRONOUNS)})) > 0 AND lt <> '' THEN lt || ': ' || p ELSE p END AS query FROM l WHERE role = 'user'""")
def retrieval_queries(t):
    searched = "role <> 'user' AND length(text) % 2 = 0"
    c = t("conversations").selectExpr("conv_id", "turn", "role", "CASE WHEN length(text) % 5 = 0 THEN ' Try again. ' ELSE text END AS text", f"CASE WHEN {searched} THEN 'vector_search' END AS tool", f"CASE WHEN {searched} THEN role || turn END AS query", f"CASE WHEN {searched} AND turn % 3 < 2 THEN array('T' || turn, 'x') END AS titles")
    return C.retrieval_queries(c)


@query("tool_budget_fold", f"""WITH c AS ({CALLS}), a AS (SELECT *, coalesce(lag(signature) OVER w = signature, false) AS again,
        last_value(CASE WHEN NOT failed THEN result END IGNORE NULLS) OVER (PARTITION BY conv_id, tool_name ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, row_number() OVER (PARTITION BY conv_id, tool_name ORDER BY turn) AS calls, row_number() OVER w AS n,
        sum(CASE WHEN tool_name = 'user' THEN 2 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT *, failed OR coalesce(result = last, false) OR (again AND result IS NULL) AS stuck FROM a),
    s AS (SELECT *, n - coalesce(max(CASE WHEN NOT again THEN n END) OVER w, 0) AS repeated, n - coalesce(max(CASE WHEN NOT stuck THEN n END) OVER w, 0) AS streak FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT conv_id, turn, CASE WHEN calls >= CASE WHEN tool_name = 'system' THEN 1 ELSE 4 END THEN 'per_tool_limit_reached' WHEN repeated >= 3 THEN 'repeat_signature_break' WHEN streak >= 2 THEN 'no_progress_break' WHEN spent > 9 THEN 'budget_units_exhausted' END AS stop_reason FROM s)
    SELECT conv_id, turn, stop_reason FROM (SELECT *, count(stop_reason) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) WHERE before = 0""")
def tool_budget_fold(t):
    return C.tool_budget(calls(t), 4, {"system": 1}, units=9, weights={"user": 2})


@query("tool_call_counts", f"SELECT conv_id, tool_name, count(*) AS n_calls FROM ({CALLS}) GROUP BY ALL")
def tool_call_counts(t):
    return C.tool_counts(calls(t).withColumn("stop_reason", F.lit(None).cast("string")))


#: Who speaks in a turn, as captions would name them: often the same, sometimes no one.
SPEAKER = "CASE WHEN turn % 3 = 2 THEN role WHEN length(text) % 5 > 0 THEN 'x' END"


@query("caption_coalesce", f"""WITH RECURSIVE m AS (SELECT conv_id, turn, {SPEAKER} AS speaker, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    f AS (SELECT conv_id, i, turn AS start_turn, 1 AS n, speaker, text FROM m WHERE i = 1 UNION ALL
        SELECT m.conv_id, m.i, CASE WHEN j THEN f.start_turn ELSE m.turn END, CASE WHEN j THEN f.n + 1 ELSE 1 END, m.speaker, CASE WHEN j THEN f.text || ' ' || m.text ELSE m.text END
        FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1, LATERAL (SELECT coalesce(m.speaker = f.speaker AND length(f.text) + 1 + length(m.text) <= 256, false) AS j))
    SELECT conv_id, CAST(start_turn AS BIGINT) AS start_turn, CAST(max(n) AS BIGINT) AS n, arg_max(speaker, n) AS speaker, arg_max(text, n) AS text FROM f GROUP BY conv_id, start_turn""")
def caption_coalesce(t):
    return C.coalesce_captions(t("conversations").select("conv_id", "turn", F.expr(SPEAKER).alias("speaker"), "text"), 256)


#: A whole text and its end again as a continuation: up to 600 characters, which overlap what comes before them by a length that varies, or by none.
PARTS = """SELECT doc_id AS id, substring(text, 1, CAST(m AS BIGINT)) AS previous, substring(text, CAST(m - least(m, doc_id % 7 * (doc_id % 31)) + 1 AS BIGINT)) AS following
    FROM (SELECT doc_id, text, length(text) - least(length(text) // 2, 20 + doc_id % 400) AS m FROM documents WHERE text IS NOT NULL)"""
CONTINUATION = f"""WITH p AS ({PARTS}), a AS (SELECT *, ltrim(following, chr(13) || chr(10)) AS c, ltrim(previous, chr(13) || chr(10)) AS w FROM p),
    b AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(w), length(c)) + 1), lambda n: substring(w, 1, n) = substring(c, 1, n))), 0) AS same FROM a),
    d AS (SELECT *, CASE WHEN previous = '' OR following = '' THEN following WHEN starts_with(w, c) THEN '' WHEN starts_with(c, previous) THEN substring(c, length(previous) + 1) WHEN same >= 24 THEN substring(c, same + 1) ELSE c END AS e FROM b),
    f AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(previous), length(e)) + 1), lambda n: ends_with(previous, substring(e, 1, n)))), 0) AS o FROM d),
    g AS (SELECT id, previous, ltrim(substring(e, CASE WHEN o >= CASE WHEN o <= 12 THEN 3 ELSE greatest(3, least(96, least(length(previous), length(e)) // 8)) END THEN o + 1 ELSE 1 END), chr(13) || chr(10)) AS rest FROM f)
    SELECT id, md5(rest) AS rest, CASE WHEN previous = '' OR regexp_matches(previous, '[\\n ]$') OR regexp_matches(previous, '!\\[[^\\]]*\\]\\([^)]*$') OR regexp_matches(rest, '^[)\\]/.,:;!?]') OR regexp_matches(previous, '[&*(\\[{{—-]\\s*$') OR len(regexp_extract_all(previous, '\\*\\*')) % 2 = 1 THEN '' ELSE chr(10) END AS separator FROM g"""


@query("continuation_merge", CONTINUATION)
def continuation_merge(t):
    d = t("documents").where("text IS NOT NULL").selectExpr("doc_id AS id", "text", "int(length(text) - least(length(text) div 2, 20 + doc_id % 400)) AS m")
    parts = d.selectExpr("id", "substring(text, 1, m) AS previous", "substring(text, m - int(least(m, id % 7 * (id % 31))) + 1) AS following")
    return continuation.continue_text(parts).select("id", F.md5("rest").alias("rest"), "separator")


FACT = r"""trim(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({}, '[ \t\r\n\f\v]+', ' ', 'g')), '(?i)^(please )?remember( this)?( going forward)? ?[:,-]? ?', '')), '(?i)^that ', '')), ' "''')"""
LOW_VALUE = r"""(trim(lower({0}), ' .!?,:;') IN ('', 'this', 'that', 'it', 'remember this', 'remember that') OR regexp_matches({0}, '(?i)^user asked to remember:|^remembered context:|\byou should remember this\b|\bremember this\b|\bi(''| a)?ll remember that\b|\bkeep that in mind\b'))"""
CATEGORY = """CASE WHEN regexp_matches(lower(trim({0})), '^(i prefer|i like|i want|i need)') THEN 'preference' WHEN regexp_matches(lower({0}), 'we use|our stack|project|memory|tool|database|qdrant|memgraph') THEN 'project'
    WHEN regexp_matches(lower({0}), 'tone|style|concise|verbose') THEN 'tone' WHEN regexp_matches(lower({0}), 'goal|working on|building|trying to') THEN 'goals' ELSE 'general' END"""
#: What a user's turn says of them, by its length.
SAID = """CASE length(text) % 6 WHEN 0 THEN 'Please remember: that ' || text WHEN 1 THEN text || ' I prefer ' || substring(text, 1, 9) WHEN 2 THEN 'we use the ' || text WHEN 3 THEN 'Hi, my name is ' || substring(text, 1, 12) || '. I am working on ' || text WHEN 4 THEN 'remember this' ELSE text END"""


@query("fact_extraction", f"""WITH s AS (SELECT conv_id, turn, {SAID} AS text FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, turn, {FACT.format('text')} AS fact FROM s)
    SELECT conv_id, turn, fact, {CATEGORY.format('fact')} AS category FROM f WHERE NOT {LOW_VALUE.format('fact')}""")
def fact_extraction(t):
    rows = t("conversations").where("role = 'user'").select("conv_id", "turn", F.expr(SAID).alias("text")).where(~T.low_value_fact(F.col("text")))
    return rows.select("conv_id", "turn", T.fact(F.col("text")).alias("fact"), T.fact_category(T.fact(F.col("text"))).alias("category"))


FOUND = "list_filter([CASE WHEN regexp_matches(lower(text), 'remember|going forward|from now on') THEN trim(text) END, " + ", ".join(
    f"CASE WHEN x{k} <> '' THEN upper(substring(x{k}, 1, 1)) || substring(x{k}, 2) END" for k in range(len(T.FACT_PATTERNS))) + "], lambda x: x IS NOT NULL)"
HEURISTIC = f"""s AS (SELECT conv_id, turn, {SAID} AS text FROM conversations WHERE role = 'user'), x AS (SELECT *, {', '.join(f"trim(regexp_extract(trim(text), '(?i){p}')) AS x{k}" for k, p in enumerate(T.FACT_PATTERNS))} FROM s),
    l AS (SELECT conv_id, turn, {FOUND} AS found FROM x), u AS (SELECT conv_id, turn, unnest(found) AS raw, unnest(range(0, len(found))) AS i FROM l),
    f AS (SELECT conv_id, turn, i, {FACT.format('raw')} AS fact FROM u), k AS (SELECT conv_id, turn, fact, min(i) AS i FROM f WHERE NOT {LOW_VALUE.format('fact')} AND fact <> '' GROUP BY ALL)"""


@query("heuristic_facts", f"WITH {HEURISTIC} SELECT conv_id, turn, list(fact ORDER BY i) AS facts FROM k GROUP BY conv_id, turn")
def heuristic_facts(t):
    rows = t("conversations").where("role = 'user'").select("conv_id", "turn", T.heuristic_facts(F.expr(SAID)).alias("facts"))
    return rows.where("size(facts) > 0")


@query("graph_edges", """WITH e AS (SELECT vec_id AS source_id, 'REL_' || label AS relationship, (vec_id * 7 + 3) % 500 AS destination_id FROM embeddings), n AS (SELECT vec_id AS id FROM embeddings WHERE label = 1)
    SELECT source_id, relationship, destination_id, 'out' AS direction FROM e WHERE source_id IN (SELECT id FROM n) UNION ALL SELECT source_id, relationship, destination_id, 'in' FROM e WHERE destination_id IN (SELECT id FROM n)""")
def graph_edges(t):
    e = t("embeddings").select(F.col("vec_id").alias("source_id"), F.concat(F.lit("REL_"), F.col("label")).alias("relationship"), ((F.col("vec_id") * 7 + 3) % 500).alias("destination_id"))
    return graph.expand(e, t("embeddings").where("label = 1").select(F.col("vec_id").alias("id"))).select("source_id", "relationship", "destination_id", "direction")


#: Customers are the nodes; their vectors are those of ``embeddings`` with their key, and nodes without one can't be found.
NODES = "(SELECT c_custkey AS id, c_name AS name FROM customer JOIN embeddings ON vec_id = c_custkey)"


def customer_nodes(t):
    return t("customer").join(t("embeddings").select(F.col("vec_id").alias("c_custkey"), "embedding"), "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "embedding")


@query("graph_seeds", f"""SELECT id, name, CASE WHEN lower(name) = 'customer#000000007' THEN 0 ELSE 1 END AS seed_rank FROM {NODES} WHERE contains(lower(name), '00001') OR lower(name) = 'customer#000000007' ORDER BY seed_rank, id DESC LIMIT 256""")
def graph_seeds(t):
    return graph.seeds(customer_nodes(t), ["customer#000000007", "00001"]).drop("embedding")


#: Relations as a model writes them: other cases, quotes, speakers, relations under several names or that say nothing.
RAW_EDGES = """SELECT CASE WHEN c_custkey % 5 = 0 THEN ' The  User ' WHEN c_custkey % 5 = 1 THEN '"' || c_name || '!"' ELSE 'The ' || c_name END AS source,
    CASE c_custkey % 4 WHEN 0 THEN 'works on' WHEN 1 THEN ' in nation' WHEN 2 THEN 'Likes ' ELSE 'related-to' END AS relationship, CASE WHEN c_custkey % 11 = 0 THEN 'assistant' ELSE n_name END AS destination FROM customer JOIN nation ON c_nationkey = n_nationkey"""
NORMAL_EDGES = f"""SELECT s AS source, CASE r WHEN 'works_on' THEN 'WORKS_ON' WHEN 'likes' THEN 'PREFERS' ELSE upper(r) END AS relationship, d AS destination FROM (SELECT CASE WHEN lower(trim(source)) = 'the  user' THEN 'user' ELSE lower(regexp_replace(trim(source), '["!#]', '', 'g')) END AS s,
    trim(regexp_replace(lower(trim(relationship)), '[^a-z0-9]+', '_', 'g'), '_') AS r, lower(destination) AS d FROM ({RAW_EDGES})) WHERE r <> 'related_to' AND s <> d AND NOT (s IN ('user', 'assistant') AND d IN ('user', 'assistant'))"""


def raw_edges(t):
    customers = spread(t("customer").select("c_custkey", "c_name", "c_nationkey"), narrow=True)
    return customers.join(F.broadcast(t("nation")), F.expr("c_nationkey = n_nationkey")).select(
        F.expr("""CASE WHEN c_custkey % 5 = 0 THEN ' The  User ' WHEN c_custkey % 5 = 1 THEN '"' || c_name || '!"' ELSE 'The ' || c_name END""").alias("source"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'works on' WHEN 1 THEN ' in nation' WHEN 2 THEN 'Likes ' ELSE 'related-to' END").alias("relationship"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'assistant' ELSE n_name END").alias("destination"),
    )


@query("graph_normalise", f"SELECT DISTINCT * FROM ({NORMAL_EDGES})")
def graph_normalise(t):
    return graph.normalise(raw_edges(t))


@query("graph_search", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (3, 8)), e AS (SELECT vec_id AS source_id, 'REL_' || label AS relationship, (vec_id * 7 + 3) % 500 AS destination_id FROM embeddings),
    b AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score, row_number() OVER (PARTITION BY v ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id DESC) AS place FROM embeddings, q),
    n AS (SELECT id, max(score) AS score FROM b WHERE score >= 0.25 AND place <= 100 GROUP BY id)
    SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT source_id, relationship, destination_id, 'out' AS direction, score FROM e JOIN n ON id = source_id UNION ALL SELECT source_id, relationship, destination_id, 'in', score FROM e JOIN n ON id = destination_id)
    ORDER BY score DESC, direction, source_id, relationship, destination_id LIMIT 100""")
def graph_search(t):
    e = t("embeddings")
    edges = e.select(F.col("vec_id").alias("source_id"), F.concat(F.lit("REL_"), F.col("label")).alias("relationship"), ((F.col("vec_id") * 7 + 3) % 500).alias("destination_id"))
    queries = e.where("vec_id IN (3, 8)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return graph.search(e.select(F.col("vec_id").alias("id"), "embedding"), edges, queries, 0.25).withColumn("score", F.round("score", 6))


@query("graph_query_seeds", f"SELECT id, name, CAST(1 AS INTEGER) AS seed_rank FROM {NODES} ORDER BY id DESC LIMIT 256")
def graph_query_seeds(t):
    """No customer's name holds the question's words, so the newest nodes stand in."""
    return graph.by_query(customer_nodes(t), ["Tell me about the nebula", "me"]).drop("embedding")


@query("message_sync", """WITH o AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 5 <> 0), n AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn % 4 <> 0)
    SELECT coalesce(n.conv_id, o.conv_id) AS conv_id, coalesce(n.turn, o.turn) AS turn, CASE WHEN o.conv_id IS NULL THEN 'insert' WHEN n.conv_id IS NULL THEN 'delete' WHEN n.text <> o.text THEN 'update' ELSE 'keep' END AS change
    FROM n FULL JOIN o ON n.conv_id = o.conv_id AND n.turn = o.turn""")
def message_sync(t):
    c = t("conversations")
    new = c.where("turn % 4 <> 0").select("conv_id", "turn", F.expr("CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END").alias("text"))
    return sinks.changes(c.where("turn % 5 <> 0").select("conv_id", "turn", "text"), new, ["conv_id", "turn"]).select("conv_id", "turn", "change")


@query("message_upsert", """WITH o AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 5 <> 0), n AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn % 4 <> 0)
    SELECT conv_id, turn, coalesce(n.text, o.text) AS text FROM n FULL JOIN o USING (conv_id, turn)""")
def message_upsert(t):
    c = t("conversations").select("conv_id", "turn", "text")
    new = c.where("turn % 4 <> 0").select("conv_id", "turn", F.expr("CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END").alias("text"), F.lit(2).alias("seq"))
    stale = c.where("turn % 4 <> 0").select("conv_id", "turn", F.lit("stale").alias("text"), F.lit(1).alias("seq"))
    return sinks.upsert(c.where("turn % 5 <> 0"), new.union(stale), ["conv_id", "turn"], "seq", delete_missing=False)
