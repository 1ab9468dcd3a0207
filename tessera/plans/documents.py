"""Queries over documents of several subtypes, one document, and prompt skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking
from tessera.operators import documents as D
from tessera.plans.corpus import CHUNKS, QUESTION, SIMILARITY, TRIGRAMS
from tessera.plans.registry import query
from tessera.plans.relational import TREE, tree

#: Subtypes of documents, by id; each has a column that the others lack.
SUBTYPES = ("pdf", "tex", "raw_text", "vtt", "handwritten", "figure", "image", "media")
UNIFIED = "SELECT doc_id, source, " + ", ".join(f"CASE WHEN doc_id % 8 = {k} THEN lang END AS of_{n}" for k, n in enumerate(SUBTYPES)) + f", {list(SUBTYPES)}[doc_id % 8 + 1] AS doc_type FROM documents"


def unified(t):
    d = t("documents")
    return D.unified({n: d.where(f"doc_id % 8 = {k}").select("doc_id", "source", F.col("lang").alias(f"of_{n}")) for k, n in enumerate(SUBTYPES)})


@query("documents_unified", UNIFIED)
def documents_unified(t):
    return unified(t)


@query("document_lookup", f"SELECT u.doc_id, doc_type FROM ({UNIFIED}) u WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def document_lookup(t):
    order = F.array_position(F.array(*map(F.lit, SUBTYPES)), F.col("doc_type"))
    return D.by_ids(unified(t).withColumn("doc_order", order), t("labels").where("toxic = 1").select("doc_id")).select("doc_id", "doc_type")


@query("enum_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase' UNION ALL SELECT -event_id, event_type FROM events")
def enum_filter(t):
    """A known value selects, an unknown one is ignored."""
    known = ("signup", "purchase", "error")
    e = t("events").select("event_id", "event_type")
    every = D.where_known(e, "event_type", "bogus", known).select((-F.col("event_id")).alias("event_id"), "event_type")
    return D.where_known(e, "event_type", "purchase", known).union(every)


@query("name_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar')")
def name_filter(t):
    return D.named(t("part").select("p_partkey", "p_name"), "p_name", "  AR ")


@query("collection_exists", "SELECT n_nationkey AS collection_id, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS has FROM nation")
def collection_exists(t):
    groups = t("nation").select(F.col("n_nationkey").alias("collection_id"))
    return D.has_any(groups, t("customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("collection_id")), "collection_id")


@query("cost_summary", "SELECT coalesce(CAST(sum(CASE WHEN event_type = 'none' THEN user_id END) AS BIGINT), 0) AS nothing, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS users, count(*) AS n FROM events")
def cost_summary(t):
    return D.summed(t("events").select(F.expr("CASE WHEN event_type = 'none' THEN user_id END").alias("nothing"), F.col("user_id").alias("users")), "nothing", "users")


@query("media_fallback", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'No text could be extracted from this media. [ref:' || doc_id || ':' || doc_id % 3 || ':image:' || substring(sha256(CASE WHEN doc_id % 8 = 0 THEN '' ELSE source END), 1, 12) || ']' ELSE text END AS stored, left(text, 200) AS title FROM documents""")
def media_fallback(t):
    content = F.when(F.col("doc_id") % 8 != 0, F.col("source").cast("binary"))
    ref = D.media_ref(F.col("doc_id"), F.col("doc_id") % 3, F.lit("image"), content)
    text = F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text"))
    return t("documents").select("doc_id", D.stored_text(text, ref).alias("stored"), F.left("text", F.lit(D.TITLE_CHARS)).alias("title"))


@query("document_modality", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'audio' WHEN doc_id % 5 = 1 THEN 'video' WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 2 = 0 THEN 'transcript' ELSE 'text' END AS modality,
    CASE WHEN doc_id % 7 < 5 THEN 'ocr' || doc_id % 7 WHEN doc_id % 7 = 5 THEN lang ELSE '' END AS provider FROM documents""")
def document_modality(t):
    i = F.col("doc_id")
    kind = F.expr("CASE WHEN doc_id % 5 = 0 THEN ' Audio' WHEN doc_id % 5 = 1 THEN 'VIDEO ' WHEN doc_id % 5 = 2 THEN 'other' END")
    provider = D.first_named(F.expr("CASE WHEN doc_id % 7 < 5 THEN ' ocr' || doc_id % 7 ELSE '  ' END"), F.when(i % 7 == 5, F.col("lang")))
    return t("documents").select("doc_id", D.modality(kind, i % 3 == 0, i % 2 == 0).alias("modality"), provider.alias("provider"))


@query("chunk_citation", f"WITH chunks AS ({CHUNKS}) SELECT doc_id * 100000 + chunk_number AS chunk_id, doc_id, '[doc:' || doc_id || ' chunk:' || (doc_id * 100000 + chunk_number) || ']' AS citation FROM chunks WHERE doc_id % 2 = 0")
def chunk_citation(t):
    chunks = chunking.chunk(t("documents")).select((F.col("doc_id") * 100_000 + F.col("chunk_number")).alias("chunk_id"), "doc_id")
    return D.chunk_of(chunks, chunks.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1)))


@query("whole_document", "SELECT doc_id, CASE WHEN greatest(1, length(text) // 4) <= 1000 THEN text END AS text, CASE WHEN greatest(1, length(text) // 4) > 1000 THEN 'Document ' || doc_id || ' is too large to open in this chat.' END AS exception FROM documents")
def whole_document(t):
    return D.whole(t("documents").select("doc_id", "text"), 1000)


@query("single_document_search", f"""WITH chunks AS ({CHUNKS}), l AS (SELECT doc_id FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1), c AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM l)),
    s AS (SELECT *, {TRIGRAMS.format('content')} AS a, {TRIGRAMS.format("'" + QUESTION + "'")} AS b FROM c),
    g AS (SELECT doc_id, chunk_number, row_number() OVER (ORDER BY {SIMILARITY} DESC, chunk_number) AS place FROM s WHERE {SIMILARITY} > 0.000001 QUALIFY place <= 9)
    SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank, doc_id, chunk_number FROM g QUALIFY rank <= 3""")
def single_document_search(t):
    """Over the chunks of the longest document, which is the query's choice of a document."""
    longest = t("documents").select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").first()[0]
    return D.search_one(chunking.chunk(t("documents")), longest, QUESTION, 3).select("rank", "doc_id", "chunk_number")


#: Ids as a model copies them: whole, cut, with markup, of another document, too short.
HEX = "md5(CAST(doc_id AS VARCHAR(20)))"
UUID = f"concat(substring({HEX}, 1, 8), '-', substring({HEX}, 9, 4), '-', substring({HEX}, 13, 4), '-', substring({HEX}, 17, 4), '-', substring({HEX}, 21, 12))"
ASKED = f"CASE doc_id % 6 WHEN 0 THEN {UUID} WHEN 1 THEN substring({UUID}, 1, 24) WHEN 2 THEN concat('<doc_id>', upper({UUID}), '</doc_id> ') WHEN 3 THEN concat(substring({UUID}, 1, 33), 'fff') WHEN 4 THEN substring({UUID}, 1, 15) ELSE concat('x', substring(md5(source), 1, 18)) END"


@query("id_resolution", f"""SELECT doc_id AS request_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN {UUID} WHEN doc_id % 6 = 3 AND substring({UUID}, 34, 3) = 'fff' THEN {UUID} END AS doc_id,
    CASE WHEN doc_id % 6 = 3 AND substring({UUID}, 34, 3) <> 'fff' THEN 'not_in_chat' WHEN doc_id % 6 > 3 THEN 'invalid' END AS error FROM documents""")
def id_resolution(t):
    d = t("documents")
    return D.resolve(d.select(F.col("doc_id").alias("request_id"), F.expr(ASKED.replace("VARCHAR(20)", "STRING")).alias("raw")), d.select(F.expr(UUID.replace("VARCHAR(20)", "STRING")).alias("doc_id")))


@query("source_pages", r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id, url, html FROM pages WHERE length(html) > 0)
    SELECT host, md5(string_agg('--- Source: ' || url || ' ---' || chr(10) || chr(10) || html, chr(10) || chr(10) ORDER BY page_id)) AS text_md5, count(*) AS n FROM p GROUP BY host""")
def source_pages(t):
    from tessera.sources import web

    p = t("pages").where("length(html) > 0").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.col("page_id").alias("place"), "url", F.col("html").alias("text"))
    return web.joined(p, "host").select("host", F.md5("text").alias("text_md5"), "n")


#: Skill documents in a tree of collections: pages of a collection by id, some named as skills, packs below.
SKILL_DOC = """CASE doc_id % 4 WHEN 0 THEN concat('---', chr(10), 'name: Skill ', source, chr(10), 'description: About ', lang, chr(10), '---', chr(10), text) WHEN 1 THEN text WHEN 2 THEN '  ' ELSE concat('---', chr(10), 'title: T', chr(10), '---', chr(10), 'body') END"""
SKILL_TITLE = "CASE doc_id % 3 WHEN 0 THEN concat('docs/Fits-header skill', CAST(doc_id AS VARCHAR(20)), '.md') WHEN 1 THEN concat('notes ', CAST(doc_id AS VARCHAR(20)), ' Skill.MD') ELSE 'SKILL' END"


@query("collection_skills", f"""WITH c AS (SELECT id, parent_id, CASE WHEN id % 5 = 3 AND id >= 100 THEN 'Skill-Pack' ELSE name END AS name, id % 5 = 3 AND id >= 100 AS pack FROM ({TREE})), d AS (SELECT 100 + doc_id % 25 AS cid, {SKILL_TITLE} AS title, trim({SKILL_DOC}) AS text, doc_id % 7 = 0 AS is_text FROM documents UNION ALL SELECT doc_id % 5, {SKILL_TITLE}, trim({SKILL_DOC}), false FROM documents WHERE doc_id % 10 = 0),
    p AS (SELECT *, trim(CASE WHEN starts_with(text, '---') THEN regexp_replace(text, '(?s)^---\\n.*?\\n---(\\n|$)', '') ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS body, nullif(regexp_extract(text, '\\nname: ([^\\n]*)', 1), '') AS n1, nullif(regexp_extract(text, '\\ntitle: ([^\\n]*)', 1), '') AS n2, nullif(regexp_extract(text, '\\ndescription: ([^\\n]*)', 1), '') AS de,
        CASE WHEN title = 'SKILL' THEN 'skill' ELSE trim(regexp_replace(lower(regexp_replace(regexp_replace(title, '^.*/', ''), '(?i)\\.md$', '')), '[\\s_-]+', '_', 'g'), '_') END AS k FROM d),
    r AS (SELECT cid, title, k = 'skill' OR ends_with(k, '_skill') AS marked, is_text OR ends_with(lower(title), '.md') AS plain, '## Collection Skill: ' || CASE WHEN starts_with(text, '---') THEN coalesce(n1, n2) ELSE list_aggregate(list_transform(string_split(regexp_replace(k, '_skill$', ''), '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END
        || coalesce(chr(10) || chr(10) || 'Description:' || chr(10) || CASE WHEN starts_with(text, '---') THEN de END, '') || chr(10) || chr(10) || body AS part FROM p WHERE body <> ''),
    s AS (SELECT DISTINCT s_suppkey % 10 AS user_id, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 5 ELSE 100 + s_nationkey END AS id FROM supplier),
    o AS (SELECT user_id, 0 AS phase, name, c.id, pack FROM s JOIN c USING (id) UNION ALL SELECT user_id, 1, name, c.id, pack FROM s JOIN c ON c.parent_id = s.id WHERE pack),
    j AS (SELECT user_id, phase, name, id, title, part FROM o JOIN r ON r.cid = o.id WHERE CASE WHEN pack THEN plain ELSE marked END)
    SELECT user_id, md5(rtrim(left(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY phase, name, id, title, part), 12000))) AS prompt FROM j GROUP BY user_id""")
def collection_skills(t):
    c = tree(t).withColumn("name", F.expr("CASE WHEN id % 5 = 3 AND id >= 100 THEN 'Skill-Pack' ELSE name END"))
    part = lambda where, cid, text: t("documents").where(where).select(F.expr(cid).cast("long").alias("collection_id"), F.expr(SKILL_TITLE.replace("VARCHAR(20)", "STRING")).alias("title"), F.expr(SKILL_DOC).alias("text"), F.expr(text).alias("is_text"))
    docs = part("true", "100 + doc_id % 25", "doc_id % 7 = 0").union(part("doc_id % 10 = 0", "doc_id % 5", "false"))
    selected = t("supplier").select((F.col("s_suppkey") % 10).alias("user_id"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 5 ELSE 100 + s_nationkey END").cast("long").alias("collection_id"))
    return D.skills(c, docs, selected).select("user_id", F.md5("prompt").alias("prompt"))


@query("citation_quote", r"""WITH m AS (SELECT item_id, text AS m FROM benchmark), c AS (SELECT doc_id, text, doc_id % 40 AS item_id FROM documents), s AS (SELECT doc_id, m, unnest(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')) AS sentence,
        unnest(range(0, len(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')))) AS i FROM c JOIN m USING (item_id)),
    w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(m), '[^a-z]+'), lambda x: length(x) >= 3)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '[^a-z]+'), lambda x: length(x) >= 3)) AS b FROM s),
    o AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / greatest(1, sqrt(len(a)) * sqrt(len(b))) ELSE 0 END AS score FROM w)
    SELECT doc_id, arg_min(md5(sentence), struct_pack(a := -score, b := i)) AS quote FROM o WHERE score > 0 GROUP BY doc_id""")
def citation_quote(t):
    m = t("benchmark").select("item_id", F.col("text").alias("message"))
    rows = t("documents").withColumn("item_id", F.col("doc_id") % 40).join(m, "item_id")
    return rows.select("doc_id", F.md5(D.quote(F.col("message"), F.col("text"))).alias("quote")).where("quote IS NOT NULL")


#: Ids of documents as UUIDs, and who has selected and may see them: users by the rest of the id.
UUIDS = "SELECT doc_id AS n, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS id FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)"


@query("id_scope", f"""WITH u AS ({UUIDS}) SELECT n AS request_id, CASE WHEN n % 6 IN (0, 1, 2) THEN id END AS doc_id, CASE n % 6 WHEN 3 THEN 'no_access' WHEN 4 THEN 'no_such_document' WHEN 5 THEN 'invalid' END AS error FROM u""")
def id_scope(t):
    """Whole ids and beginnings of the selected, whole ids of others that may be seen, of others that may not, of none, and beginnings of these."""
    h = F.md5(F.col("doc_id").cast("string"))
    u = t("documents").select(F.col("doc_id").alias("n"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("id"), h.alias("h"))
    raw = F.expr("CASE n % 6 WHEN 0 THEN concat('<id>', upper(id), '</id>') WHEN 1 THEN substring(h, 1, 18) WHEN 2 THEN id WHEN 3 THEN id WHEN 4 THEN md5(concat('no', n)) ELSE substring(md5(concat('no', n)), 1, 20) END")
    owned = lambda where: u.where(where).select(F.lit(1).alias("user_id"), F.col("id").alias("doc_id"))
    return D.resolve_in_scope(u.select(F.col("n").alias("request_id"), F.lit(1).alias("user_id"), raw.alias("raw")), owned("n % 6 IN (0, 1)"), owned("n % 6 IN (0, 1, 2)"), u.select(F.col("id").alias("doc_id")))


@query("search_answers", """WITH r AS (SELECT doc_id // 3 AS search_id, doc_id % 3 + 1 AS rank, doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS title, CASE WHEN length(text) > 1500 THEN rtrim(substring(text, 1, 1500)) || '... [truncated]' ELSE text END AS x, doc_id % 4 = 0 AS img FROM documents WHERE doc_id // 3 % 4 > 0),
    g AS (SELECT search_id, count(*) AS n, list_sort(list_distinct(list(coalesce(title, 'Untitled Document')))) AS titles, bool_or(img) AS shows_images, string_agg(CAST(rank AS VARCHAR) || ':' || doc_id || ':' || md5(x) || ':' || CASE WHEN img THEN CASE WHEN doc_id % 8 = 0 THEN 'image' ELSE 'text_with_image' END || '/m/' || doc_id || '/' ELSE '' END, ';' ORDER BY rank) AS rows FROM r GROUP BY search_id),
    s AS (SELECT DISTINCT doc_id // 3 AS search_id FROM documents)
    SELECT search_id, coalesce(rows, '') AS rows, CASE WHEN n IS NULL THEN 'no_results' ELSE 'results_found' END AS status, CASE WHEN n IS NULL THEN 'I searched ' || CASE WHEN search_id % 8 = 0 THEN 'my papers' ELSE 'documents' END || CASE WHEN search_id % 3 = 0 THEN '' ELSE ' for "dark matter ' || search_id || '"' END || ', but retrieval returned no relevant passages.' END AS message,
    coalesce(n, 0) AS n, coalesce(titles, []) AS titles, coalesce(shows_images, false) AS shows_images FROM s LEFT JOIN g USING (search_id)""")
def search_answers(t):
    """Results of three rows for searches of which every fourth finds nothing; documents with images, as pictures and as text beside one."""
    from tessera.operators import search

    d = t("documents").withColumn("search_id", F.expr("doc_id div 3"))
    results = d.where("search_id % 4 > 0").select("search_id", (F.col("doc_id") % 3 + 1).alias("rank"), F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_number"), F.expr("CASE WHEN doc_id % 5 > 0 THEN source END").alias("title"), F.col("text").alias("content"), F.expr("CASE WHEN doc_id % 8 = 0 THEN 'image' ELSE 'text' END").alias("modality"), (F.col("doc_id") % 4 == 0).alias("has_image"))
    searches = d.select("search_id").distinct().select("search_id", F.expr("CASE WHEN search_id % 3 = 0 THEN '  ' ELSE concat(' dark  matter ', search_id) END").alias("text"), F.expr("CASE WHEN search_id % 8 = 0 THEN ' my  papers' END").alias("scope"))
    parsed = F.from_json("result", "array<struct<r:int,d:string,x:string,ty:string,u:string>>")
    line = F.transform(parsed, lambda x: F.concat(x["r"].cast("string"), F.lit(":"), x["d"], F.lit(":"), F.md5(x["x"]), F.lit(":"), F.coalesce(F.concat(x["ty"], x["u"]), F.lit(""))))
    return search.pack_results(results, searches, "/m/", compact=True).select("search_id", F.array_join(line, ";").alias("rows"), "status", "message", "n", "titles", "shows_images")
