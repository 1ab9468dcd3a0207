"""Queries over documents, chunks, vectors and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, evidence, graph, search, trigram_index, vector_index
from tessera.plans.registry import query
from tessera.plans.rules import first_sentence, squeezed, useful
from tessera.shared import spread

#: Search text of the hybrid queries: a passage of the benchmark.
QUESTION = "That and onesen erblest it hein ti inenan eranenes whou therouou"
TERMS = ("therouou", "eranenes")

CHUNKS = """SELECT doc_id, CAST(k AS INTEGER) AS chunk_number, CAST(k * 1664 AS INTEGER) AS start_position, CAST(least(k * 1664 + 2048, length(text)) AS INTEGER) AS end_position,
    substring(text, CAST(k * 1664 + 1 AS BIGINT), 2048) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1664 + 1)) AS k FROM documents WHERE length(text) > 0)"""
TRIGRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
SIMILARITY = "len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))"
TRIGRAM_LEG = f"""SELECT doc_id, chunk_number, content, similarity, row_number() OVER (ORDER BY similarity DESC, doc_id, chunk_number) AS place FROM (
    SELECT *, {SIMILARITY} AS similarity FROM (SELECT *, {TRIGRAMS.format('content')} AS a, {TRIGRAMS.format("'" + QUESTION + "'")} AS b FROM chunks)) WHERE similarity > 0.000001 QUALIFY place <= 12"""


@query("chunk_windows", CHUNKS)
def chunk_windows(t):
    return chunking.chunk(t("documents"))


@query("chunk_reuse", CHUNKS)
def chunk_reuse(t):
    return chunking.reuse_chunks(t("documents")).select("doc_id", "chunk_number", "start_position", "end_position", "content")


@query("chunk_image_caption", f"""WITH chunks AS ({CHUNKS}), l AS (SELECT doc_id, max(end_position) AS place, max(chunk_number) AS n FROM chunks GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), ''), 'Image chunk') AS content FROM documents)
    SELECT doc_id, coalesce(n, -1) + 1 AS chunk_number, coalesce(place, 0) AS start_position, CAST(coalesce(place, 0) + length(content) AS INTEGER) AS end_position, content FROM d LEFT JOIN l USING (doc_id)""")
def chunk_image_caption(t):
    docs = t("documents").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END").alias("caption"))
    return chunking.image_chunks(docs, chunking.chunk(t("documents")))


@query("chunk_integrity", f"""WITH chunks AS ({CHUNKS}) SELECT count(*) AS n_chunks, count(DISTINCT (doc_id, chunk_number)) AS n_keys, CAST(count_if(start_position >= end_position) AS BIGINT) AS n_bad,
    count(*) - count(DISTINCT (doc_id, start_position, end_position)) AS n_same_span FROM chunks""")
def chunk_integrity(t):
    c = chunking.chunk(t("documents"))
    return c.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id", "chunk_number").alias("n_keys"), F.count_if(F.expr("start_position >= end_position")).alias("n_bad"), (F.count("*") - F.count_distinct("doc_id", "start_position", "end_position")).alias("n_same_span"))


@query("exact_dedupe", """WITH h AS (SELECT doc_id, source, sha256(text) AS text_hash FROM documents)
    SELECT *, min(doc_id) OVER (PARTITION BY source, text_hash) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY source, text_hash) AS accepted FROM h""")
def exact_dedupe(t):
    return chunking.exact_duplicates(t("documents"), "source")


@query("trigram_similarity_benchmark", f"""WITH p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, {TRIGRAMS.format('a.text')} AS a, {TRIGRAMS.format('b.text')} AS b FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id)
    SELECT a_id, b_id, round({SIMILARITY}, 6) AS similarity FROM p WHERE {SIMILARITY} > 0.000001""")
def trigram_similarity_benchmark(t):
    index = trigram_index.TrigramIndex.build(t("benchmark").select(F.col("item_id").alias("key"), "text"))
    return index.pairs().withColumn("similarity", F.round("similarity", 6))


@query("trigram_index_topk", f"""WITH chunks AS ({CHUNKS}), c AS MATERIALIZED (SELECT doc_id * 100000 + chunk_number AS key, {TRIGRAMS.format('content')} AS a FROM chunks), q AS MATERIALIZED (SELECT item_id AS q, {TRIGRAMS.format('text')} AS b FROM benchmark),
    s AS (SELECT q, key, {SIMILARITY} AS similarity FROM c, q)
    SELECT q, key, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, key) AS INTEGER) AS rank FROM s WHERE similarity > 0.000001 QUALIFY rank <= 12""")
def trigram_index_topk(t):
    """The chunks most like each item of ``benchmark``, for all items at once."""
    keyed = chunking.chunk(t("documents")).select((F.col("doc_id") * 100_000 + F.col("chunk_number")).alias("key"), F.col("content").alias("text"))
    found = trigram_index.top(keyed, t("benchmark").select(F.col("item_id").alias("q"), "text"), 12)
    return found.select("q", "key", F.round("similarity", 6).alias("similarity"), "rank")


@query("trigram_topk", f"WITH chunks AS ({CHUNKS}) SELECT doc_id, chunk_number, round(similarity, 6) AS similarity FROM ({TRIGRAM_LEG})")
def trigram_topk(t):
    return search.trigram_top(chunking.chunk(t("documents")), QUESTION, search.limits(QUESTION, 10)).select("doc_id", "chunk_number", F.round("similarity", 6).alias("similarity"))


@query("exact_term_topk", f"WITH chunks AS ({CHUNKS}) SELECT doc_id, chunk_number FROM chunks WHERE contains(lower(content), 'therouou') OR contains(lower(content), 'eranenes') ORDER BY doc_id, chunk_number LIMIT 12")
def exact_term_topk(t):
    return search.exact_top(chunking.chunk(t("documents")), TERMS, 12).select("doc_id", "chunk_number")


#: Vectors of the hybrid search: those of ``embeddings`` with a document's id stand for its first chunk; the query's is one of them.
HYBRID = f"""WITH chunks AS ({CHUNKS}), g AS ({TRIGRAM_LEG}), q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
    v AS (SELECT doc_id, chunk_number, content, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), v), doc_id, chunk_number) AS place FROM chunks JOIN embeddings ON vec_id = doc_id, q WHERE chunk_number = 0 QUALIFY place <= 12),
    e AS (SELECT doc_id, chunk_number, content, row_number() OVER (ORDER BY doc_id, chunk_number) AS place FROM chunks WHERE contains(lower(content), 'therouou') QUALIFY place <= 12),
    u AS (SELECT doc_id, chunk_number, content, 0 AS leg, place FROM v UNION ALL SELECT doc_id, chunk_number, content, 1, place FROM g UNION ALL SELECT doc_id, chunk_number, content, 2, place FROM e),
    f AS (SELECT doc_id, chunk_number, any_value(content) AS content, min(leg * 1000 + place) AS spot FROM u GROUP BY ALL)"""


def first_chunk_vectors(t, chunks):
    e = t("embeddings")
    q = e.where("vec_id = 7").first()["embedding"]
    near = e.select(F.col("vec_id").alias("doc_id"), V.l2_distance(F.col("embedding"), F.array(*map(F.lit, map(float, q)))).alias("distance"))
    return chunks.where("chunk_number = 0").join(near, "doc_id").select("doc_id", "chunk_number", "distance")


@query("hybrid_search", HYBRID + """ SELECT CAST(row_number() OVER (ORDER BY spot) AS INTEGER) AS rank, doc_id, chunk_number, coalesce(source || '-' || lang, 'Untitled Document') AS title, '[doc:' || doc_id || ' chunk:' || chunk_number || ']' AS citation,
        CASE WHEN length(content) > 1500 THEN rtrim(substring(content, 1, 1500)) || '... [truncated]' ELSE content END AS text FROM f JOIN documents USING (doc_id) QUALIFY rank <= 10""")
def hybrid_search(t):
    chunks = chunking.chunk(spread(t("documents").select("doc_id", "text")))
    found = search.hybrid(chunks, QUESTION + ' "therouou"', 10, vectors=first_chunk_vectors(t, chunks))
    return search.pack(found, t("documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("title")))


@query("more_context", f"""WITH chunks AS ({CHUNKS}) SELECT w.doc_id, w.chunk_number AS center, string_agg(c.content, chr(10) ORDER BY c.chunk_number) AS text, count(*) AS n_chunks
    FROM chunks w JOIN chunks c ON c.doc_id = w.doc_id AND c.chunk_number BETWEEN w.chunk_number - 1 AND w.chunk_number + 1 WHERE w.chunk_number = 1 GROUP BY ALL""")
def more_context(t):
    c = chunking.chunk(t("documents"))
    return search.around(c, c.where("chunk_number = 1"), 1)


@query("vector_topk_l2", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
    SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS distance FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), vec_id LIMIT 12""")
def vector_topk_l2(t):
    e = t("embeddings")
    q = e.where("vec_id = 7").first()["embedding"]
    return search.vector_top(e, q, 12).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_cosine_threshold", """WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id < 5),
    s AS (SELECT vec_id AS id, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS score FROM embeddings, q GROUP BY vec_id) SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.25""")
def vector_cosine_threshold(t):
    e = t("embeddings")
    return graph.similar_nodes(e.select(F.col("vec_id").alias("id"), "embedding"), e.where("vec_id < 5").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), 0.25, limit=None).select("id", F.round("score", 6).alias("score"))


@query("vector_index_topk", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT q.vec_id AS q, b.vec_id AS id, round(list_distance(q.v, b.v), 6) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.vec_id) AS INTEGER) AS rank
    FROM v q, v b WHERE q.vec_id % 100 = 0 QUALIFY rank <= 12""")
def vector_index_topk(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vector_index.VectorIndex.build(rows, 64).nearest(rows.where("id % 100 = 0").withColumnRenamed("id", "q"), 12)
    return found.select("q", "id", F.round("distance", 6).alias("distance"), "rank")


@query("vector_similar_pairs", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
    FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.35""")
def vector_similar_pairs(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vector_index.similar(rows, rows.withColumnRenamed("id", "q"), 0.35, 64)
    return found.where("q < id").select(F.col("q").alias("a_id"), F.col("id").alias("b_id"), F.round("similarity", 6).alias("similarity"))


@query("vector_fit_dims", "SELECT vec_id, 1024 AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, round(CAST(embedding[3] AS DOUBLE), 6) AS third FROM embeddings")
def vector_fit_dims(t):
    v = V.fit_dims(F.col("embedding"))
    return t("embeddings").select("vec_id", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.round(v[2].cast("double"), 6).alias("third"))


@query("vector_memory_topk", """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS distance FROM embeddings, q WHERE nullif(label, 0) IS DISTINCT FROM 2 ORDER BY 3, vec_id LIMIT 5""")
def vector_memory_topk(t):
    e = t("embeddings")
    q = e.where("vec_id = 3").first()["embedding"]
    keep = e.where(~F.expr("nullif(label, 0)").eqNullSafe(2))
    return search.vector_top(keep, q, 5).join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("lexical_salience_pairs", r"""WITH s AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 3)) AS w FROM benchmark)
    SELECT a.item_id AS a_id, b.item_id AS b_id, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / greatest(1, sqrt(len(a.w)) * sqrt(len(b.w))) ELSE 0 END, 6) AS overlap FROM s a JOIN s b ON a.item_id < b.item_id""")
def lexical_salience_pairs(t):
    """Texts meet in the words they share; all other pairs overlap by 0."""
    words = t("benchmark").select("item_id", T.lexical_words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    both = words.toDF("a_id", "m", "word").join(words.toDF("b_id", "n", "word"), "word").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("met"), F.max("m").alias("m"), F.max("n").alias("n"))
    ids = t("benchmark").select("item_id")
    pairs = ids.toDF("a_id").join(ids.toDF("b_id"), F.expr("a_id < b_id"))
    both = pairs.join(both, ["a_id", "b_id"], "left")
    return both.select("a_id", "b_id", F.round(F.coalesce("met", F.lit(0)) / F.greatest(F.lit(1.0), F.sqrt(F.coalesce("m", F.lit(0))) * F.sqrt(F.coalesce("n", F.lit(0)))), 6).alias("overlap"))


@query("text_measures", r"""SELECT doc_id, greatest(1, length(text) // 4) AS tokens, CAST(CAST(regexp_matches(text, '\[[0-9]+\]') AS INTEGER) * 0.15 + CAST(regexp_matches(text, '(^|[^A-Za-z0-9_])10\.[0-9]{4,}/[^ \t\r\n]') OR contains(lower(text), 'doi:') AS INTEGER) * 0.2
    + CAST(regexp_matches(text, '(^|[^A-Za-z0-9_])(19|20)[0-9]{2}([^A-Za-z0-9_]|$)') AS INTEGER) * 0.05 AS DOUBLE) AS boost, """ + useful("trim(text, ' ' || chr(9) || chr(10) || chr(13))") + " AS useful FROM documents")
def text_measures(t):
    c = F.col("text")
    return t("documents").select("doc_id", T.token_estimate(c).alias("tokens"), F.round(T.citation_boost(c), 2).alias("boost"), T.useful_sentence(c).alias("useful"))


@query("text_first_sentence", f"SELECT doc_id, {first_sentence('one', 260)} AS head FROM (SELECT doc_id, {squeezed('text')} AS one FROM documents)")
def text_first_sentence(t):
    return t("documents").select("doc_id", T.first_sentence(F.col("text")).alias("head"))


@query("text_cleaning", r"""SELECT doc_id, md5(regexp_replace(text, '([A-Za-z])-[ \t\r\n]+([A-Za-z])', '\1\2', 'g')) AS joined, md5(regexp_replace(text, 'é', '', 'g')) AS dropped, CASE WHEN length(text) > 1500 THEN length(rtrim(substring(text, 1, 1500))) + 15 ELSE length(text) END AS cut_length,
    CASE WHEN length(title) > 60 THEN substring(title, 1, 51) || '-' || substring(sha1(title), 1, 8) ELSE title END AS name FROM (SELECT *, substring(text, 1, CAST(20 + doc_id % 80 AS BIGINT)) AS title FROM documents)""")
def text_cleaning(t):
    d = t("documents").withColumn("title", F.substring("text", F.lit(1), (20 + F.col("doc_id") % 80).cast("int")))
    return d.select("doc_id", F.md5(T.unhyphenate(F.col("text"))).alias("joined"), F.md5(T.drop_nul(F.replace("text", F.lit("é"), F.lit("\x00")))).alias("dropped"), F.length(T.cut(F.col("text"))).cast("long").alias("cut_length"), T.fit_name(F.col("title"), 60).alias("name"))


EVIDENCE = f"""WITH chunks AS ({CHUNKS}), r AS (SELECT doc_id % 7 AS query_id, doc_id, chunk_number, content, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY md5(doc_id || ':' || chunk_number)) AS rank FROM chunks),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth, min(rank) OVER (PARTITION BY query_id, doc_id) AS fr FROM r QUALIFY nth <= 3),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth, fr) AS position FROM c),
    b AS (SELECT *, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS used FROM p QUALIFY used <= 3500 OR position = 1)
    SELECT query_id, list('[doc:' || doc_id || ' chunk:' || chunk_number || ']' ORDER BY position) AS citation_tokens, list_sort(list(DISTINCT doc_id)) AS doc_ids, count(*) AS n_chunks FROM b GROUP BY query_id"""


@query("evidence_packet", EVIDENCE)
def evidence_packet(t):
    r = chunking.chunk(t("documents")).select((F.col("doc_id") % 7).alias("query_id"), "doc_id", "chunk_number", "content")
    return evidence.packet(evidence.fill(r.withColumn("rank", F.md5(F.concat_ws(":", "doc_id", "chunk_number")))))


@query("answer_summary", r"""WITH d AS (SELECT doc_id, doc_id % 11 AS query_id, row_number() OVER (PARTITION BY doc_id % 11 ORDER BY doc_id) AS position, trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')) AS one FROM documents),
    h AS (SELECT *, CASE WHEN regexp_extract(one, '^(.+?[.!?])( |$)', 1) = '' THEN one ELSE regexp_extract(one, '^(.+?[.!?])( |$)', 1) END AS head FROM d),
    p AS (SELECT query_id, position, '- ' || CASE WHEN length(head) > 240 THEN rtrim(substring(head, 1, 240)) || '...' ELSE head END || ' [doc:' || doc_id || ' chunk:0]' AS point FROM h),
    u AS (SELECT query_id, point, min(position) AS position FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM u)
    SELECT query_id, string_agg(point, chr(10) ORDER BY position) AS summary FROM n WHERE n <= 5 GROUP BY query_id""")
def answer_summary(t):
    d = t("documents").select("doc_id", (F.col("doc_id") % 11).alias("query_id"), F.lit(0).alias("chunk_number"), F.col("text").alias("content"))
    return evidence.summary(d.withColumn("position", F.col("doc_id")))


@query("citation_checks", """WITH a AS (SELECT doc_id, '[doc:' || doc_id || ' chunk:0]' AS own, '[doc:' || (doc_id + 1) || ' chunk:1]' AS other FROM documents)
    SELECT doc_id, [other] AS invalid, CASE WHEN doc_id % 2 = 0 THEN [own] ELSE [own, 'x'] END AS kept FROM a""")
def citation_checks(t):
    d = t("documents").select("doc_id", T.citation(F.col("doc_id"), F.lit(0)).alias("own"), T.citation(F.col("doc_id") + 1, F.lit(1)).alias("other"))
    answer = F.concat(F.lit("see "), F.when(F.col("doc_id") % 2 == 0, F.col("own")).otherwise(F.lit("")), F.lit(" and "), F.col("other"), F.lit(" "), F.col("other"))
    allowed = F.when(F.col("doc_id") % 2 == 0, F.array("own")).otherwise(F.array(F.col("own"), F.lit("x")))
    return d.select("doc_id", evidence.invalid_citations(answer, allowed).alias("invalid"), evidence.allowed_or_all(T.citations(answer), allowed).alias("kept"))


@query("line_scan", r"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(t, chr(10))))) AS line_no, string_split(t, chr(10)) AS p FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || '```' || chr(10)) AS t FROM documents)),
    x AS (SELECT doc_id, line_no, p[line_no + 1] AS line FROM l), f AS (SELECT *, starts_with(ltrim(line), '```') AS fence, sum(CAST(starts_with(ltrim(line), '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM x)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(regexp_matches(line, '^[ \t]*([-*]|[0-9]+[.)]) ')) AS BIGINT) AS n_bullets, CAST(count_if(fence OR n % 2 = 1) AS BIGINT) AS n_code, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM f GROUP BY doc_id""")
def line_scan(t):
    rows = evidence.lines(t("documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n```\n")).alias("text")), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("bullet").alias("n_bullets"), F.count_if("in_code").alias("n_code"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("document_filter", "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def document_filter(t):
    return t("documents").join(t("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("collection_counts", "SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def collection_counts(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("highlight_window", f"""WITH chunks AS ({CHUNKS}), c AS (SELECT doc_id, chunk_number, text, length(text) AS n, start_position AS s, end_position AS e FROM chunks JOIN documents USING (doc_id))
    SELECT doc_id, chunk_number, CAST(CASE WHEN n > 5000 THEN greatest(0, s - 500) ELSE 0 END AS BIGINT) AS text_offset,
    md5(CASE WHEN n > 5000 THEN substring(text, CAST(greatest(0, s - 500) + 1 AS BIGINT), CAST(least(n, e + 500) - greatest(0, s - 500) AS BIGINT)) ELSE text END) AS window_md5 FROM c""")
def highlight_window(t):
    c = chunking.chunk(t("documents")).select("doc_id", "chunk_number", "start_position", "end_position").join(t("documents").select("doc_id", "text"), "doc_id")
    w = search.highlight(F.col("text"), F.col("start_position"), F.col("end_position"), threshold=5_000, padding=500)
    return c.select("doc_id", "chunk_number", w["text_offset"].alias("text_offset"), F.md5(w["window"]).alias("window_md5"))


@query("exact_terms", r"""WITH q AS (SELECT item_id, CASE WHEN item_id %% 3 = 0 THEN text || ' "' || substring(text, 3, 20) || '" NGC-1275 which document' ELSE 'EU-x.y ' || text || ' ''' || substring(text, 1, 9) || '''' END AS text FROM benchmark),
    r AS (SELECT item_id, list_concat(regexp_extract_all(text, '("[^"]{3,96}"|''[^'']{3,96}'')', 1), list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_./:+\-]{2,}'), lambda w: regexp_matches(w, '[-_./:+0-9]|[A-Z].*[A-Z]') OR length(w) >= 10)) AS a FROM q),
    b AS (SELECT item_id, list_filter(list_transform(a, lambda w: trim(w, ' "''`.,;:!?()[]{}' || chr(9) || chr(10) || chr(13))), lambda w: length(w) >= 3 AND NOT list_contains(%s, lower(w))) AS b FROM r)
    SELECT item_id, list_filter(b, lambda w, i: list_position(list_transform(b, lambda x: lower(x)), lower(w)) = i)[1:8] AS terms FROM b""" % list(T.TERM_STOP_WORDS))
def exact_terms(t):
    text = F.expr("""CASE WHEN item_id % 3 = 0 THEN text || ' "' || substring(text, 3, 20) || '" NGC-1275 which document' ELSE 'EU-x.y ' || text || " '" || substring(text, 1, 9) || "'" END""")
    return t("benchmark").select("item_id", T.exact_terms(text).alias("terms"))


@query("seed_terms", r"""WITH w AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '[^a-z0-9_.+\- ]+', '', 'g'), '[a-z0-9_.+\-]+') AS w FROM benchmark)
    SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i AND length(x) >= 3 AND NOT list_contains(%s, x)) AS terms FROM w""" % [*T.SEED_STOP_WORDS, "assistant", "user"])
def seed_terms(t):
    return t("benchmark").select("item_id", T.seed_terms(F.col("text")).alias("terms"))


@query("embedding_hash_rank", None)
def embedding_hash_rank(t):
    chunks = chunking.chunk(t("documents"))
    q = V.hashing_embedding(F.lit(QUESTION))
    legs = chunks.withColumn("distance", V.l2_distance(V.hashing_embedding(F.col("content")), q))
    return search.hybrid(chunks, QUESTION, 5, vectors=legs).select("rank", "doc_id", "chunk_number")
