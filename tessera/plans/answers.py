"""Queries around answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access, answers, search
from tessera.plans.registry import query
from tessera.plans.relational import TREE, UP, tree
from tessera.plans.rules import snippets


@query("title_id_map", "SELECT source, title, max(doc_id) AS doc_id FROM (SELECT source, lang || (doc_id % 3) AS title, doc_id FROM documents) GROUP BY ALL")
def title_id_map(t):
    d = t("documents").select("source", F.concat("lang", F.col("doc_id") % 3).alias("title"), "doc_id")
    return answers.titles_to_ids(d, "source").select("source", F.explode("ids").alias("title", "doc_id"))


@query("last_search", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND length(text) % 2 = 0 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_query FROM conversations")
def last_search(t):
    rows = t("conversations").withColumn("query", F.when((F.col("role") == "user") & (F.length("text") % 2 == 0), F.col("text")))
    return answers.last_known(rows, "conv_id", "turn", "query").select("conv_id", "turn", "last_query")


@query("recent_evidence", f"""WITH b AS (SELECT conv_id, turn, role AS source, text, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4), {snippets('b')},
    d AS (SELECT * FROM snippet WHERE snippet <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, substring(snippet, 1, 180) ORDER BY back) = 1)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY back) AS INTEGER) AS n, source, snippet AS text FROM d QUALIFY n <= 10""")
def recent_evidence(t):
    """Turns stand for results of one row each."""
    return answers.recent(t("conversations").select("conv_id", "turn", F.lit(0).alias("row_no"), F.col("role").alias("source"), "text"))


@query("source_refs", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ['[doc:' || doc_id || ']'] WHEN 1 THEN ['[doc:a' || doc_id || ']', '[doc:b' || doc_id || ']', '[doc:c]', '[doc:z' || doc_id || ']']
    WHEN 2 THEN ['[doc:' || doc_id || ']'] WHEN 3 THEN ['[doc:' || doc_id || ']'] ELSE [] END AS refs FROM documents""")
def source_refs(t):
    """A document named by the call, by rows under their long and short names and by images, by a single row, by a text, by nothing."""
    arguments = F.expr("""CASE doc_id % 5 WHEN 0 THEN concat('{"doc_id": " ', doc_id, ' "}') WHEN 1 THEN '{}' END""")
    result = F.expr("""CASE doc_id % 5 WHEN 0 THEN '[]'
        WHEN 1 THEN concat('[{"doc_id": "b', doc_id, '"}, {"d": "a', doc_id, '"}, 7, {"doc_id": "", "d": "c"}, {"doc_id": "c", "u": "/m/document_image/z', doc_id, '/1"}]')
        WHEN 2 THEN concat('{"doc_id": ', doc_id, ', "text": "x"}') WHEN 3 THEN concat('"see /m/document_image/', doc_id, '/p"') END""")
    return t("documents").select("doc_id", answers.source_refs(arguments, result).alias("refs"))


@query("sources_block", """WITH d AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)
    SELECT doc_id, md5(t || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || 'Sources:' || chr(10) || '- [doc:a]' || chr(10) || '- [doc:b]' WHEN 2 THEN chr(10) || 'Sources:' || chr(10) || '- [doc:a]'
    WHEN 3 THEN chr(10) || 'Sources: none' || chr(10) || '- [doc:a]' || chr(10) || '- [doc:b]' ELSE ' [doc:x chunk:1]' || chr(10) || chr(10) || 'Sources:' || chr(10) || '- [doc:x chunk:1]' END) AS answer FROM d""")
def sources_block(t):
    """Nothing allowed; no list yet; a list that names one; a list that names none; a citation that is used."""
    end = F.expr("CASE doc_id % 5 WHEN 2 THEN concat(char(10), 'Sources:', char(10), '- [doc:a]') WHEN 3 THEN concat(char(10), 'Sources: none') WHEN 4 THEN ' [doc:x chunk:1]' ELSE '' END")
    said = F.concat(F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""), end, F.lit(" \n"))
    allowed = F.expr("CASE doc_id % 5 WHEN 0 THEN array() WHEN 4 THEN array('[doc:y chunk:2]', '[doc:x chunk:1]') ELSE array('[doc:b]', '[doc:a]') END")
    return t("documents").select("doc_id", F.md5(answers.with_sources(said, allowed)).alias("answer"))


@query("new_figures", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'See ![x](/m/1) and a plain /m/2' || chr(10) || chr(10) ELSE '![Cap ' || source || '](/m/1)' || chr(10) END || '![T](/m/2)' || chr(10) || '![Figure](/else/3)' AS answer FROM documents""")
def new_figures(t):
    """Links under both names, one twice, one from elsewhere; an answer that shows the first one, and an empty answer."""
    chunks = F.expr("""array(named_struct('image_url', '/m/1', 'u', '', 'title', '', 'text', concat('Cap', char(10), source)), named_struct('image_url', '', 'u', '/m/2', 'title', ' T ', 'text', 'y'),
        named_struct('image_url', '/m/1', 'u', '', 'title', 'again', 'text', ''), named_struct('image_url', 'http://x/4', 'u', '', 'title', 'out', 'text', ''), named_struct('image_url', CAST(NULL AS STRING), 'u', CAST(NULL AS STRING), 'title', '', 'text', ''))""")
    lines = answers.figure_lines(chunks, F.array(F.lit("/m/2"), F.lit("/else/3"), F.lit("/else/4")), "/m/")
    return t("documents").select("doc_id", answers.with_figures(F.when(F.col("doc_id") % 2 == 0, "See ![x](/m/1) and a plain /m/2 \n").otherwise(F.lit(None)), lines).alias("answer"))


@query("recent_images", """WITH b AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4), r AS (SELECT conv_id, back, 0 AS place, '/m/' || turn % 3 AS link, 'Figure ' || turn % 3 AS caption FROM b UNION ALL SELECT conv_id, back, 2, '/n/' || turn, 'A view of it' FROM b WHERE turn % 2 = 0),
    d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, link ORDER BY back, place) = 1) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY back, place) AS INTEGER) AS n, '![' || caption || '](' || link || ')' AS line FROM d QUALIFY n <= 3""")
def recent_images(t):
    """Each turn shows an image that others show too, one as data and, every second turn, one of its own."""
    c = t("conversations")
    part = lambda place, link, caption: c.select("conv_id", "turn", F.lit(place).alias("place"), F.expr(link).alias("link"), F.expr(caption).alias("caption"))
    rows = part(0, "concat('/m/', turn % 3)", "concat('Figure ', turn % 3)").union(part(1, "'data:image/png;base64,x'", "'A view'"))
    return answers.recent_images(rows.union(part(2, "concat('/n/', turn)", "CASE WHEN turn % 2 = 0 THEN concat(' A view', char(10), 'of it ') ELSE 'untitled' END")))


@query("retrieval_notice", """WITH n AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'The document search tool failed: no index' WHEN event_id % 3 = 1 THEN 'Nothing found for ' || event_type ELSE '' END AS notice FROM events)
    SELECT event_id, notice, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 1 AND event_id % 7 <> 0 THEN 'NOTHING FOUND for ' || event_type || '.' WHEN notice = '' THEN 'Answer' ELSE 'Answer' || chr(10) || chr(10) || notice END AS answer FROM n""")
def retrieval_notice(t):
    """Tools that search and one that doesn't; failed, empty and good results; answers that say it already."""
    tool = F.expr("CASE WHEN event_id % 7 = 0 THEN 'other_tool' WHEN event_id % 2 = 0 THEN 'vector_search' ELSE ' more_context ' END")
    error, status = F.expr("CASE WHEN event_id % 3 = 0 THEN ' no index' ELSE ' ' END"), F.expr("CASE WHEN event_id % 3 = 1 THEN 'no_results' ELSE 'ok' END")
    notice = answers.notice(tool, error, status, F.concat(F.lit("Nothing found for "), "event_type"))
    said = F.expr("CASE WHEN event_id % 5 = 0 AND event_id % 3 = 1 AND event_id % 7 <> 0 THEN concat('NOTHING FOUND for ', event_type, '.') ELSE 'Answer  ' END")
    return t("events").select("event_id", notice.alias("notice"), answers.with_notice(said, notice).alias("answer"))


@query("closing_turns", """WITH m AS (SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER w AS used, row_number() OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn FROM m WHERE used <= 120 OR back = 1""")
def closing_turns(t):
    return answers.from_end(t("conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens")), 120)


@query("selected_with_ancestors", f"WITH RECURSIVE tree AS ({TREE}), {UP} SELECT DISTINCT ancestor_id AS id FROM up WHERE id % 7 = 3")
def selected_with_ancestors(t):
    return answers.with_ancestors(tree(t).where("id % 7 = 3").select("id"), access.ancestors(tree(t)))


@query("path_resolution", f"""WITH RECURSIVE tree AS ({TREE}), {UP}, p AS (SELECT up.id, string_agg(t.name, '/' ORDER BY depth DESC) AS path FROM up JOIN tree t ON t.id = up.ancestor_id GROUP BY up.id), w AS (SELECT n_name AS wanted FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'none')
    SELECT wanted, coalesce((SELECT id FROM p WHERE path = wanted), (SELECT min(id) FROM p WHERE ends_with(path, '/' || wanted))) AS id FROM w""")
def path_resolution(t):
    wanted = t("nation").select(F.col("n_name").alias("wanted")).union(t("region").select("r_name")).union(t("region").limit(1).select(F.lit("none")))
    return answers.resolve_paths(wanted, access.paths(tree(t)))


@query("sorted_page", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY lower(c_name) DESC, id LIMIT 25 OFFSET 25")
def sorted_page(t):
    return answers.sorted_page(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "name", 2, descending=True)


@query("given_order", "SELECT c_custkey, c_name, CASE c_custkey WHEN 9 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS pos FROM customer WHERE c_custkey IN (9, 4, 30)")
def given_order(t):
    return search.by_given_order(t("customer").select("c_custkey", "c_name"), [9, 4, 30], "c_custkey")


@query("prompt_markup", "SELECT doc_id, 'a [image] ' || lang AS seen, lang AS name, source AS kind, CAST(doc_id % 9 AS INTEGER) AS cap FROM documents")
def prompt_markup(t):
    d = t("documents")
    raw = F.concat(F.lit("<think>x\ny</think>a data:image/png;base64,AAAA= "), F.col("lang"))
    matter = T.front_matter(F.concat(F.lit("---\nName: "), F.col("lang"), F.lit("\nkind: "), F.col("source"), F.lit("\n---\nbody")))
    caps = T.number_map(F.concat(F.lit("bad,vector:"), F.col("doc_id") % 9, F.lit(",x:y")))
    return d.select("doc_id", T.redact_images(T.visible(raw)).alias("seen"), matter["name"].alias("name"), matter["kind"].alias("kind"), caps["vector"].alias("cap"))
