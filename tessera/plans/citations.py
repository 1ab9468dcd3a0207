"""Queries over citations, reranking answers, anchors, message rows and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import anchors as A
from tessera.operators import citations as C
from tessera.operators import messages as M
from tessera.operators import reranking as R
from tessera.plans.registry import query
from tessera.sources import arxiv, media

#: Answers as a model writes them: sentences as list items under a cited line, with code and headings between.
ANSWER = """concat('Intro ', CASE WHEN doc_id % 3 = 0 THEN concat('[doc:', CAST(doc_id AS VARCHAR(20)), ' chunk:1]') ELSE 'plain' END, chr(10), '```', chr(10), '- code line is here', chr(10), '```', chr(10), '# - Head of all', chr(10), '  - indented claim number one', chr(10), '- ', replace(replace(text, chr(10), ' '), '. ', concat('.', chr(10), '* ')), chr(10), '2. ends with a colon:', chr(10), '- ok [doc:', CAST(doc_id AS VARCHAR(20)), ' chunk:2] [doc:x chunk:9]')"""
LINES = rf"""l AS (SELECT doc_id AS id, unnest(range(0, len(string_split(t, chr(10))))) AS line_no, string_split(t, chr(10)) AS p FROM (SELECT doc_id, {ANSWER} AS t FROM documents)), x AS (SELECT id, line_no, p[line_no + 1] AS raw, regexp_replace(p[line_no + 1], '^\s+|\s+$', '', 'g') AS line FROM l),
    f AS (SELECT *, sum(CAST(starts_with(line, '```') AS INTEGER)) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM x), s AS (SELECT *, NOT starts_with(line, '```') AND n % 2 = 0 AND line <> '' AND NOT regexp_matches(line, '^(#|!\[)') AS said, regexp_matches(line, '\[doc:[^\]\s]+\s+chunk:[0-9]+\]') AS cites, regexp_matches(line, '^([-*]\s+|[0-9]+\.\s+)') AS item FROM f),
    r AS (SELECT *, coalesce(last_value(CASE WHEN said AND NOT item THEN cites END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING), false) AS rests FROM s),
    u AS (SELECT id, line_no, line FROM r WHERE said AND item AND NOT ends_with(line, ':') AND regexp_matches(line, '[A-Za-z]') AND len(regexp_extract_all(line, '[A-Za-z0-9]+')) >= 3 AND NOT cites AND NOT (rests AND regexp_matches(raw, '^\s')))"""


def answered(t):
    return t("documents").select(F.col("doc_id").alias("id"), F.expr(ANSWER.replace("VARCHAR(20)", "STRING")).alias("text"))


@query("uncited_lines", f"WITH {LINES} SELECT id, CAST(line_no AS INTEGER) AS line_no, line FROM u")
def uncited_lines(t):
    return C.uncited(answered(t))


@query("citation_enforcement", f"""WITH {LINES}, n AS (SELECT id, count(*) AS n FROM u GROUP BY id), d AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN ['[doc:' || doc_id || ' chunk:1]'] ELSE [] END AS first, '[doc:' || doc_id || ' chunk:2]' AS second FROM documents),
    a AS (SELECT *, CASE id % 4 WHEN 0 THEN [] WHEN 1 THEN ['[doc:x chunk:9]', second] WHEN 2 THEN ['[doc:' || id || ' chunk:1]', '[doc:x chunk:9]', second] ELSE [second] END AS allowed FROM d)
    SELECT id, list_filter(list_concat(first, [second, '[doc:x chunk:9]']), lambda c: NOT list_contains(allowed, c)) AS invalid, coalesce(n, 0) AS n_uncited, len(allowed) = 0 OR (len(list_filter(list_concat(first, [second, '[doc:x chunk:9]']), lambda c: NOT list_contains(allowed, c))) = 0 AND coalesce(n, 0) = 0) AS passed FROM a LEFT JOIN n USING (id)""")
def citation_enforcement(t):
    mark = lambda doc, k: f"concat('[doc:', {doc}, ' chunk:{k}]')"
    allowed = F.expr(f"CASE id % 4 WHEN 0 THEN array() WHEN 1 THEN array('[doc:x chunk:9]', {mark('id', 2)}) WHEN 2 THEN array({mark('id', 1)}, '[doc:x chunk:9]', {mark('id', 2)}) ELSE array({mark('id', 2)}) END").cast("array<string>")
    return C.checked(answered(t).withColumn("allowed", allowed))


@query("allowed_citations", """WITH r AS (SELECT conv_id, turn, role, length(text) AS n, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, list_sort(list_distinct(list(CASE WHEN n % 3 = 0 THEN '[doc:' || role || ' chunk:' || n || ']' WHEN n % 3 = 1 THEN '[doc:d' || turn || ' chunk:7]' END) FILTER (n % 3 < 2))) AS allowed FROM r WHERE back <= 4 GROUP BY conv_id HAVING count(*) FILTER (n % 3 < 2) > 0""")
def allowed_citations(t):
    rows = t("conversations").select("conv_id", "turn", F.lit(0).alias("row_no"), F.expr("CASE WHEN length(text) % 3 = 0 THEN concat('see [doc:', role, ' chunk:', length(text), '] x') END").alias("citation"), F.concat(F.lit(" d"), "turn").alias("doc_id"), F.expr("CASE WHEN length(text) % 3 = 1 THEN '7' ELSE 'x' END").alias("chunk_id"))
    return C.allowed(rows).where("size(allowed) > 0")


@query("citation_links", r"""WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents), u AS (SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS u FROM h)
    SELECT doc_id, 'see <a href="/doc/' || u || '/?chunk=' || doc_id || '" data-doc-id="' || u || '" data-chunk-id="' || doc_id || '">[doc:' || u || ' chunk:' || doc_id || ']</a> and [doc:x chunk:1]' AS linked, '![' || coalesce(nullif(substring(trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN source || ' [a]' ELSE ' ' END, '[\[\]]', '', 'g')), 1, 80), ''), 'Image') || '](/i/' || doc_id || ')' AS figure FROM u JOIN documents USING (doc_id)""")
def citation_links(t):
    hexa = F.md5(F.col("doc_id").cast("string"))
    uuid = F.regexp_replace(hexa, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    text = F.concat(F.lit("see [doc:"), uuid, F.lit(" chunk:"), F.col("doc_id").cast("string"), F.lit("] and [doc:x chunk:1]"))
    caption = F.expr("CASE WHEN doc_id % 2 = 0 THEN source || ' [a]' ELSE ' ' END")
    return t("documents").select("doc_id", C.linked(text, "/doc/{id}/").alias("linked"), C.figure(caption, F.concat(F.lit("/i/"), "doc_id")).alias("figure"))


#: Answers of a reranking service, some with bad and repeated indexes, some under another name.
BODY = """concat('{"', CASE WHEN doc_id % 2 = 0 THEN 'results' ELSE 'data' END, '": [{"index": ', CAST(doc_id % 5 AS VARCHAR(9)), ', "score": 0.5}, {"index": 9, "score": 1}, {"index": "a"}, {"index": 1, "relevance_score": ', CAST(doc_id % 7 AS VARCHAR(9)), '}, {"index": -1, "score": 2}, {"index": ', CAST(doc_id % 5 AS VARCHAR(9)), '}]}')"""


@query("rerank_order", "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN [1] ELSE [CAST(doc_id % 5 AS INTEGER), 1] END AS places, 0.5 + 1 + doc_id % 7 + 2 AS total, 0.5 AS first FROM documents")
def rerank_order(t):
    body = F.expr(BODY.replace("VARCHAR(9)", "STRING"))
    total = F.aggregate(R.scores(body), F.lit(0.0), lambda s, x: s + x["score"])
    return t("documents").select("doc_id", R.order(body, F.lit(5)).alias("places"), total.alias("total"), R.single_score(body).alias("first"))


@query("passage_anchors", r"""WITH d AS (SELECT doc_id, trim(text) AS w FROM documents), c AS (SELECT *, left(w, 150) AS a, right(w, 150) AS b FROM d), p AS (SELECT *, 150 - instr(reverse(a), ' ') AS l, instr(b, ' ') - 1 AS r FROM c)
    SELECT doc_id, CASE WHEN length(w) <= 150 THEN w WHEN l < 150 AND l > 75 THEN left(a, CAST(l AS BIGINT)) ELSE a END AS first, CASE WHEN length(w) <= 150 THEN w WHEN r >= 0 AND r < 75 THEN substring(b, CAST(r + 2 AS BIGINT)) ELSE b END AS last FROM p""")
def passage_anchors(t):
    return t("documents").select("doc_id", A.start_anchor(F.col("text")).alias("first"), A.end_anchor(F.col("text")).alias("last"))


@query("passage_location", None)
def passage_location(t):
    """A passage of each document's middle among its words, forty to a page."""
    words = t("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "text"))
    items = words.select("doc_id", F.floor(F.col("n") / 40).cast("int").alias("page"), (F.col("n") % 40).cast("int").alias("item"), "text")
    middle = F.substring("text", (F.length("text") / 3).cast("int") + 1, F.lit(420))
    return A.locate(items, t("documents").select(F.col("doc_id").alias("passage_id"), "doc_id", middle.alias("text")))


@query("message_rows", """SELECT conv_id, CAST(turn AS BIGINT) AS sequence_number, role, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN '' ELSE text END AS content, CASE WHEN role = 'assistant' THEN 'm' || turn END AS model, CASE WHEN role = 'assistant' THEN coalesce(CASE WHEN turn % 2 = 0 THEN 'tool_use' END, 'end_turn') END AS stop_reason FROM conversations""")
def message_rows(t):
    """There and back again; every third turn of an assistant is a status line."""
    c = t("conversations").select("conv_id", "turn", "role", F.expr("CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'Searching...' ELSE text END").alias("content"), F.concat(F.lit("m"), "turn").alias("model"), F.expr("CASE WHEN turn % 2 = 0 THEN 'tool_use' END").alias("stop_reason"))
    rows = M.from_rows(M.to_rows(c)).select("conv_id", F.explode("messages").alias("m"))
    return rows.select("conv_id", F.col("m.sequence_number").cast("long").alias("sequence_number"), "m.role", "m.content", "m.model", "m.stop_reason")


@query("image_urls", "SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN 'data:' || CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/gif' END || ';base64,' || base64(encode(text)) END AS url FROM documents")
def image_urls(t):
    name = F.expr("CASE doc_id % 3 WHEN 0 THEN 'a.PNG' WHEN 1 THEN 'noname' ELSE 'x.y.gif' END")
    return t("documents").select("doc_id", F.regexp_replace(media.data_url(F.col("text").cast("binary"), name, 2000), "[\r\n]", "").alias("url"))


@query("arxiv_ids", "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '2401.' || lpad(CAST(doc_id % 10000 AS VARCHAR), 5, '0') END AS id FROM documents")
def arxiv_ids(t):
    n = F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 10000).cast("string"), 5, "0"))
    raw = F.when(F.col("doc_id") % 4 == 0, n).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://arxiv.org/abs/"), n, F.lit("v2"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("arXiv:"), n)).otherwise(F.concat(F.lit("x"), n, F.lit("y")))
    return t("documents").select("doc_id", arxiv.arxiv_id(raw).alias("id"))
