"""Queries over prompts within a context window, and offline evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, evaluation
from tessera.operators import prompts as P
from tessera.plans.conversations import sql_word
from tessera.operators import conversation as C
from tessera.plans.registry import query
from tessera.plans.rules import snippets

TOKENS = "greatest(1, length({}) // 4)"
#: Turns with tools' results among them, by their length.
TOOLED = """CASE WHEN role = 'user' AND length(text) % 3 = 0 THEN concat('Tool vector_search result: head', chr(10), 'second', chr(10), 'third ', CAST(length(text) % 2 AS VARCHAR(9)), chr(10), text) ELSE text END"""


def tooled(t):
    return t("conversations").select("conv_id", "turn", "role", F.expr(TOOLED.replace("VARCHAR(9)", "STRING")).alias("text"))


@query("prompt_tokens", f"SELECT conv_id, CAST(12 + sum(6 + {TOKENS.format('role')} + {TOKENS.format('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def prompt_tokens(t):
    return P.prompt_tokens(t("conversations"))


@query("context_reserve", "SELECT doc_id, least(4096, greatest(96, CAST(floor(doc_id * 977 * CAST(0.015 AS DOUBLE)) AS BIGINT))) AS guard, least(2048, greatest(64, CAST(floor(doc_id * 977 * CAST(0.0075 AS DOUBLE)) AS BIGINT))) AS pad FROM documents")
def context_reserve(t):
    guard, pad = P.reserve(F.col("doc_id") * 977)
    return t("documents").select("doc_id", guard.cast("long").alias("guard"), pad.cast("long").alias("pad"))


@query("pinned_results", f"""WITH m AS (SELECT conv_id, turn, role, {TOOLED} AS text FROM conversations), e AS (SELECT *, role = 'user' AND starts_with(text, 'Tool vector_search result:') AS ev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
    o AS (SELECT *, sum(CASE WHEN b > 1 AND NOT ev THEN 1 ELSE 0 END) OVER w AS others, sum(CASE WHEN role = 'user' AND NOT ev THEN 1 ELSE 0 END) OVER w AS users, max(CASE WHEN b = 2 AND ev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS results FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY b ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, max(CASE WHEN role = 'user' AND NOT ev AND users <= 1 THEN b END) OVER (PARTITION BY conv_id) AS cut FROM o)
    SELECT conv_id, turn, b = 1 OR (results = 1 AND b > 1 AND (others = 0 OR (others = 1 AND NOT ev AND role = 'assistant' AND turn % 2 = 1))) OR coalesce(b <= cut, false) AS pinned FROM c""")
def pinned_results(t):
    return P.pinned(tooled(t).withColumn("has_calls", F.col("turn") % 2 == 1), 1)


@query("header_dedupe", None)
def header_dedupe(t):
    """Turns of users alone, so that tools' results stand side by side."""
    return P.dedupe_headers(tooled(t).where("role = 'user'"))


@query("text_shortening", r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\. ', '.' || repeat(chr(10), CAST(1 + doc_id % 5 AS INTEGER)), 'g') AS t FROM documents), s AS (SELECT doc_id, t, regexp_split_to_array(regexp_replace(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM d)
    SELECT doc_id, md5(CASE WHEN regexp_matches(t, '\n{4,}') THEN regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') ELSE t END) AS collapsed,
    md5(CASE WHEN length(t) >= 500 AND len(p) > 2 AND length(array_to_string(p[1:2], ' ')) + 24 < length(t) THEN array_to_string(p[1:2], ' ') || chr(10) || '[Context shortened.]' ELSE t END) AS shortened FROM s""")
def text_shortening(t):
    x = F.regexp_replace(F.col("text"), r"\. ", "\x02")
    x = F.replace(x, F.lit("\x02"), F.concat(F.lit("."), F.repeat(F.lit("\n"), (1 + F.col("doc_id") % 5).cast("int"))))
    return t("documents").select("doc_id", F.md5(P.collapse(x)).alias("collapsed"), F.md5(P.shorten(x)).alias("shortened"))


@query("preflight_trim", f"""WITH m AS (SELECT conv_id, turn, text, 6 + {TOKENS.format('role')} + {TOKENS.format('text')} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    l AS (SELECT *, 12 + sum(cost) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN i > 0 THEN cost END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb FROM m),
    k AS (SELECT *, 12 + sum(cost) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS rest FROM l WHERE NOT (i > 0 AND i < n - 1 AND i <= 32 AND lb > 340)),
    a AS (SELECT *, CASE WHEN i > 0 AND rest = 2 AND total > 340 AND length(text) > 0 AND n - rest < 32 THEN CASE WHEN length(text) <= greatest(128, (total - 340) * 12) THEN '[Earlier context trimmed due to token limit.]' ELSE substring(text, CAST(greatest(128, (total - 340) * 12) + 1 AS BIGINT)) END ELSE text END AS after FROM k),
    b AS (SELECT *, total - sum({TOKENS.format('text')} - {TOKENS.format('after')}) OVER (PARTITION BY conv_id) AS now FROM a)
    SELECT conv_id, turn, md5(after) AS text, CAST(CASE WHEN now > 340 AND 740 - now >= 256 AND 740 - now < 400 THEN 740 - now ELSE 400 END AS BIGINT) AS max_tokens FROM b""")
def preflight_trim(t):
    return P.preflight(t("conversations"), limit=900, completion=400).select("conv_id", "turn", F.md5("text").alias("text"), "max_tokens")


@query("context_pack", None)
def context_pack(t):
    """Conversations with tools' results in a small window; every second assistant's turn has asked for one."""
    rows = tooled(t).withColumn("has_calls", (F.col("role") == "assistant") & (F.col("turn") % 2 == 0))
    return P.pack(rows, C.salience(rows), 1400, 200, system=40, last=1, history=300, results=150, slack=64).withColumn("text", F.md5("text"))


@query("summary_prompt", f"""WITH e AS (SELECT conv_id, turn + 1 AS n, role AS source, text FROM conversations WHERE turn < 8), l AS (SELECT conv_id, string_agg(n || '. [' || source || '] ' || text, chr(10) ORDER BY n) AS lines FROM e GROUP BY conv_id), u AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, md5('User request: ' || coalesce(nullif(trim(q), ''), 'Summarize the key points from these retrieved document excerpts.') || chr(10) || chr(10) || 'Evidence snippets:' || chr(10) || lines) AS prompt FROM l LEFT JOIN u USING (conv_id)""")
def summary_prompt(t):
    c = t("conversations")
    found = c.select("conv_id", (F.col("turn") + 1).alias("n"), F.col("role").alias("source"), "text")
    return P.summary_prompt(found, C.last_user(c)).select("conv_id", F.md5("prompt").alias("prompt"))


#: Cases of the evaluation: turns as messages, with and without collections, with and without results.
MESSAGE = """CASE length(text) % 5 WHEN 0 THEN concat('Please search the selected documents for ', substring(text, 1, 12)) WHEN 1 THEN concat('What does this paper say about ', substring(text, 1, 9), '?') WHEN 2 THEN 'Try again' ELSE text END"""
CASES = f"SELECT conv_id * 1000 + turn AS id, {MESSAGE} AS text, turn % 3 > 0 AS chosen, CASE WHEN turn % 4 = 0 THEN 'no_results' ELSE 'results_found' END AS status, concat('Based on ', text) AS answer, substring(text, 1, 5) AS part FROM conversations"
REASON = f"""CASE WHEN regexp_matches(text, '(?i){C.RETRY}') THEN 'r' WHEN {sql_word(C.LOCAL)} THEN 'l' WHEN {sql_word(C.FIGURE_TARGET)} AND {sql_word(C.FIGURE_ACTION)} THEN 'f' WHEN {sql_word(C.DOC_TARGET)} AND {sql_word(C.DOC_ACTION)} THEN 'e'
    WHEN chosen AND list_bool_or(list_transform({list(C.DOC_CUES)}, lambda w: contains(lower(text), w))) AND list_bool_or(list_transform({list(C.QUESTION_CUES)}, lambda w: contains(lower(text), w))) THEN 'c' ELSE 'n' END"""


@query("rag_evaluation", f"""WITH c AS ({CASES}), w AS (SELECT *, {REASON} IN ('r', 'f', 'e', 'c') AS wanted FROM c),
    r AS (SELECT *, CASE WHEN NOT wanted THEN '' WHEN NOT chosen THEN 'Select a collection to search first.' WHEN status = 'no_results' THEN 'I searched the selected documents for "' || text || '", but retrieval returned no relevant passages.' ELSE answer END AS content FROM w)
    SELECT id, wanted AND (wanted AND chosen) AND contains(lower(content), lower(part)) AS passed,
    CAST(CASE WHEN wanted THEN 0 ELSE 1 END + CASE WHEN wanted AND chosen THEN 0 ELSE 1 END + CASE WHEN contains(lower(content), lower(part)) THEN 0 ELSE 1 END AS INTEGER) AS n_failures FROM r""")
def rag_evaluation(t):
    c = t("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(MESSAGE).alias("message"), F.expr("CASE WHEN turn % 3 > 0 THEN array(1) ELSE array() END").cast("array<int>").alias("collection_ids"),
        F.expr("CASE WHEN turn % 4 = 0 THEN 'no_results' ELSE 'results_found' END").alias("status"), F.concat(F.lit("Based on "), "text").alias("answer"), F.array(F.substring("text", 1, 5)).alias("expect_contains"),
    )
    expected = c.select("id", F.lit("handled").alias("expect_outcome"), F.lit(True).alias("expect_searched"), "expect_contains")
    return evaluation.check(evaluation.run(c), expected).select("id", "passed", F.size("failures").alias("n_failures"))


@query("evaluation_tally", "SELECT CAST(count_if(quality = 1) AS BIGINT) AS n_passed, CAST(count_if(quality <> 1) AS BIGINT) AS n_failed FROM labels")
def evaluation_tally(t):
    return evaluation.tally(t("labels").select((F.col("quality") == 1).alias("passed")))


@query("evidence_snippets", f"WITH {snippets('documents')} SELECT doc_id, snippet FROM snippet")
def evidence_snippets(t):
    return t("documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))
