"""Queries over files, captions and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.registry import query
from tessera.sources import captions, files, web

PAGE_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""
LINKS = r"""SELECT DISTINCT page_id, link FROM (SELECT page_id, root, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN root || href END AS link FROM (
    SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '<a[^>]* href="([^"#]+)', 1)) AS href FROM pages)) WHERE link = root OR starts_with(link, root || '/')"""


@query("page_text", f"SELECT page_id, {PAGE_TEXT} AS text FROM pages")
def page_text(t):
    return t("pages").select("page_id", web.text(F.col("html")).alias("text"))


@query("page_links", LINKS)
def page_links(t):
    return web.links(t("pages"))


@query("page_crawl", f"""WITH l AS ({LINKS}), s AS (SELECT page_id, url, 0 AS depth FROM pages WHERE page_id < 20),
    n AS (SELECT page_id, url, 1 AS depth FROM pages WHERE url IN (SELECT link FROM l WHERE page_id IN (SELECT page_id FROM s)) AND page_id NOT IN (SELECT page_id FROM s)), a AS (SELECT * FROM s UNION ALL SELECT * FROM n)
    SELECT page_id, a.url, depth, {PAGE_TEXT} AS text FROM a JOIN pages USING (page_id) WHERE length({PAGE_TEXT}) >= 50""")
def page_crawl(t):
    p = t("pages")
    return web.crawl(p, p.where("page_id < 20").select("url"))


@query("file_types", """SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'html' ELSE ['text', 'csv', 'pdf', 'archive', 'image'][doc_id % 6 + 1] END AS type FROM documents""")
def file_types(t):
    name = F.element_at(F.array(*map(F.lit, ("a.TXT", "b.csv", "c.d.pdf", "e.zip", "f.jpeg", "noext"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t("documents").select("doc_id", files.detect(name, F.lit("text/html; charset=utf-8")).alias("type"))


@query("caption_rows", """SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS idx, CAST(turn * 2 AS DOUBLE) AS start_s, CAST(turn * 2 + 1.5 AS DOUBLE) AS end_s, role AS speaker, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM conversations""")
def caption_rows(t):
    c = t("conversations")
    two = lambda s: F.concat(T.clock(s), F.lit("."))
    cue = F.concat(two(F.col("turn") * 2), F.lit("000 --> "), two(F.col("turn") * 2 + 1), F.lit("500\n"), F.col("role"), F.lit(": "), F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "cue")))
    doc = c.withColumn("cue", cue).groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(ordered, lambda x: x["cue"]), "\n\n")).alias("text"))
    return captions.parse(doc)


@query("file_payloads", "SELECT 'd' || doc_id || '.txt' AS filename, 'd' || doc_id || '.txt' AS member, 'text' AS type, 'd' || doc_id AS title, text, 'success' AS status, CAST(NULL AS VARCHAR) AS error FROM documents")
def file_payloads(t):
    return files.parse(t("documents").select(F.concat(F.lit("/x/d"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content")))
