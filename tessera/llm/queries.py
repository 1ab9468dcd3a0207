"""Registered queries of the language-model operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ball_tree, boosting, decontaminate, hard_negatives, html_text, language, license_scan, near_dup, quality_rules, sentencepiece_codec, substring, toxicity, url_filter
from tessera.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"), near_dup.NearDup(width=4))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).drop("kept_text", "text_key")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rules of the URL query, and the entries its list holds: whole domains.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
URL_LIST = tuple(f"{name}.example.{top}/" for name in ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x") for top in ("com", "net", "org"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in URL_LIST], "key string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed, URL_RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), sentencepiece_codec.load())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=relabelled)


QUERIES = {
    "op1_substring": op1_substring,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_license_scan": op7_license_scan,
    "op8_near_dup": op8_near_dup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language": op10_language,
    "op11_centroids": op11_centroids,
    "op12_html_text": op12_html_text,
    "op13_hard_negatives": op13_hard_negatives,
}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER_WORDS = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

UNICODE_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
SHINGLES = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))"


def _license_sql() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    phrases = ", ".join(f"('{label}', {p.split()}, {len(p.split())})" for p, label in license_scan.PHRASES)
    split, percent = license_scan.split, license_scan.PERCENT
    parts = [(k, t.label, list(dict.fromkeys(split(t.text))), len(split(t.text)), list(t.telling), list(t.excluding)) for k, t in enumerate(license_scan.TEMPLATES)]
    templates = ", ".join(f"({k}, '{label}', {tokens}, {n}, {-(-percent * len(tokens) // 100)}, {telling or 'CAST([] AS VARCHAR[])'}, {excluding or 'CAST([] AS VARCHAR[])'})" for k, label, tokens, n, telling, excluding in parts)
    return f"""
        WITH w AS (SELECT doc_id, {words} AS w FROM documents), p(label, phrase, n) AS (VALUES {phrases}), t(k, label, tokens, n, need, telling, excluding) AS (VALUES {templates}),
        b AS (SELECT doc_id, label, list_filter(range(0, len(w) - n + 1), lambda i: w[i + 1:i + n] = phrase) AS places FROM w, p),
        base AS (SELECT doc_id, CAST(sum(len(places)) AS BIGINT) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
            coalesce(string_agg(label, ',' ORDER BY label) FILTER (len(places) > 0), '') AS base_labels FROM b GROUP BY doc_id),
        c AS (SELECT doc_id, w, label, tokens, n, need, telling, excluding FROM w, t WHERE len(list_intersect(tokens, w)) >= need),
        x AS (SELECT *, w[i + 1:i + 2 * n] AS part, ' ' || array_to_string(w[greatest(0, i - n) + 1:i + 3 * n], ' ') || ' ' AS near FROM (SELECT *, unnest(range(0, len(w))) AS i FROM c) WHERE list_contains(tokens, w[i + 1])),
        m AS (SELECT doc_id, label, len(list_intersect(tokens, part)) / len(tokens) AS share FROM x
            WHERE len(list_intersect(tokens, part)) >= need AND len(list_filter(telling, lambda f: NOT contains(' ' || array_to_string(part, ' ') || ' ', ' ' || f || ' '))) = 0
            AND len(list_filter(excluding, lambda f: contains(near, ' ' || f || ' '))) = 0),
        found AS (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM b WHERE len(places) > 0),
        l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id),
        s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, n_base, first_word, last_word, base_labels, coalesce(labels, '') AS labels,
            CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
        FROM w JOIN base USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


INTEGERS = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _centroid_sql(rounds: int = 5) -> str:
    step = """
        a{i} AS MATERIALIZED (SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM
            (SELECT r, c, list_inner_product(v, v) + list_inner_product(m, m) - 2 * list_inner_product(v, m) AS d FROM v, k{i}) GROUP BY r)"""
    update = """
        s{i} AS (SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS j FROM a{i} JOIN v USING (r)) GROUP BY ALL),
        k{n} AS MATERIALIZED (SELECT c, coalesce(x.m, k{i}.m) AS m FROM k{i} LEFT JOIN
            (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS m FROM s{i} GROUP BY c) x USING (c))"""
    steps = ",".join(step.format(i=i) + ("," + update.format(i=i, n=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {INTEGERS} AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
        k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM v QUALIFY c < 40),{steps},
        i AS (SELECT c, sum(d) AS own FROM a{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(own) FROM i) AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM v JOIN a{rounds} USING (r) JOIN i USING (c) JOIN k{rounds} USING (c)"""


ORACLES = {
    "op11_centroids": _centroid_sql(),
    "op13_hard_negatives": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {INTEGERS} AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {FINITE}),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    "op7_license_scan": _license_sql(),
    "op3_url_filter": """
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
        r(rule, verdict) AS (VALUES %s),
        k(name) AS (VALUES %s),
        m AS (SELECT p.*, (SELECT max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FROM r
            WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substring(rule, length(split_part(rule, '/', 1)) + 1))) AS best FROM p)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict,
            CASE WHEN EXISTS (SELECT 1 FROM k WHERE host = name OR ends_with(host, '.' || name)) THEN 'block' ELSE 'allow' END) AS verdict FROM m"""
    % (", ".join(f"('{rule}', '{verdict}')" for verdict, rule in URL_RULES), ", ".join(f"('{k[:-1]}')" for k in URL_LIST)),
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, {UNICODE_WORDS} AS w FROM documents), b AS (SELECT item_id, {UNICODE_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        z AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0), k AS (SELECT DISTINCT k FROM z),
        i AS (SELECT item_id, k, unnest(list_distinct({SHINGLES})) AS t FROM z), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
        s AS (SELECT doc_id, k, unnest(list_distinct({SHINGLES})) AS t FROM d, k WHERE doc_id IS NOT NULL AND len(w) >= k),
        c AS (SELECT doc_id, item_id, count(*) AS n_found FROM s JOIN i USING (k, t) GROUP BY ALL)
        SELECT doc_id, item_id, n_item, n_found, round(n_found / n_item, 6) AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_item""",
    "op1_substring": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
        v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM v),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
        x AS (SELECT doc_id, list(i) AS x FROM c GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(x), 0) AS BIGINT) AS n_removed,
            sha256(array_to_string(list_filter(w, lambda t, i: NOT coalesce(list_contains(x, i), false)), ' ')) AS kept_sha256
        FROM w LEFT JOIN x USING (doc_id)""",
    "op8_near_dup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
        x AS (SELECT doc_id, unnest(s) AS t FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (len(x.s) + len(y.s) - c.n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root <= e.b)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept
        FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)""",
}
