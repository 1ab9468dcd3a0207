"""Queries of the entity graph's growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.registry import query

#: Entities are the rows of ``embeddings``; those of label 1 are nodes already, those of label 2 nodes whose vector is missing.
LEAST = 0.35
UPSERT = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, 'entity ' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
    old AS MATERIALIZED (SELECT vec_id AS id, name, CASE WHEN label = 1 THEN v END AS v FROM e WHERE label IN (1, 2)),
    b AS MATERIALIZED (SELECT e.name, max(struct_pack(s := list_cosine_similarity(e.v, old.v), id := old.id)) AS best FROM e JOIN old ON old.v IS NOT NULL AND list_cosine_similarity(e.v, old.v) >= {LEAST} GROUP BY e.name),
    w AS MATERIALIZED (SELECT e.name, e.v, CASE WHEN b.best IS NULL THEN [] ELSE [b.best] END AS best, old.id AS named FROM e LEFT JOIN b USING (name) LEFT JOIN old ON old.name = e.name),
    r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e.vec_id) AS k, s.name AS source, 'REL_' || e.label AS relationship, d.name AS destination, s.v AS sv, s.best AS sb, s.named AS sn, d.v AS dv, d.best AS db, d.named AS dn
        FROM e JOIN w s ON s.name = e.name JOIN w d ON d.name = 'entity ' || ((e.vec_id * 7 + 3) % 500) WHERE s.name <> d.name),
    t AS (SELECT max(id) AS top FROM old),
    g(k, made, relationship, source_id, destination_id) AS (
        SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, name VARCHAR, v DOUBLE[], is_new BOOLEAN)[]), CAST('' AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        UNION ALL
        SELECT k, list_concat(made, CASE WHEN sh IS NULL THEN [struct_pack(id := si, name := source, v := sv, is_new := sn IS NULL)] ELSE [] END, CASE WHEN dh IS NULL THEN [struct_pack(id := di, name := destination, v := dv, is_new := dn IS NULL)] ELSE [] END), relationship, si, di FROM (
            SELECT *, coalesce(dh.id, dn, (SELECT top FROM t) + n_new + CASE WHEN sh IS NULL AND sn IS NULL THEN 2 ELSE 1 END) AS di FROM (
                SELECT *, coalesce(sh.id, sn, (SELECT top FROM t) + n_new + 1) AS si FROM (
                    SELECT r.*, g.made, len(list_filter(g.made, lambda m: m.is_new)) AS n_new,
                        list_max(list_concat(sb, list_filter(list_transform(g.made, lambda m: struct_pack(s := list_cosine_similarity(m.v, sv), id := m.id)), lambda x: x.s >= {LEAST}))) AS sh,
                        list_max(list_concat(db, list_filter(list_transform(g.made, lambda m: struct_pack(s := list_cosine_similarity(m.v, dv), id := m.id)), lambda x: x.s >= {LEAST}))) AS dh
                    FROM g JOIN r ON r.k = g.k + 1)))),
    m AS (SELECT unnest(made) AS m FROM g WHERE k = (SELECT max(k) FROM g))"""


def grown(t):
    e = t("embeddings").select("vec_id", F.concat(F.lit("Entity "), F.col("vec_id")).alias("name"), F.lower(F.concat(F.lit("Entity "), F.col("vec_id"))).alias("normal"), "embedding", "label")
    nodes = e.where("label IN (1, 2)").select(F.col("vec_id").alias("id"), F.col("normal").alias("name"), F.expr("CASE WHEN label = 1 THEN embedding END").alias("embedding"))
    relations = e.select(F.col("vec_id").alias("n"), F.col("name").alias("source"), F.concat(F.lit("rel "), F.col("label")).alias("relationship"), F.concat(F.lit('"ENTITY '), (F.col("vec_id") * 7 + 3) % 500, F.lit('" ')).alias("destination"))
    edges = e.where("label = 3").select(F.col("vec_id").alias("source_id"), F.lit("REL_3").alias("relationship"), ((F.col("vec_id") * 7 + 3) % 500).alias("destination_id"))
    return graph.upsert(nodes, edges, relations, e.select(F.col("normal").alias("name"), F.col("embedding").alias("vector")), LEAST)


@query("graph_upsert", UPSERT + """, o AS (SELECT vec_id AS source_id, 'REL_3' AS relationship, (vec_id * 7 + 3) % 500 AS destination_id FROM embeddings WHERE label = 3)
    SELECT *, false AS is_new FROM o UNION ALL SELECT *, true FROM (SELECT source_id, relationship, destination_id FROM g WHERE k > 0 EXCEPT SELECT * FROM o)""")
def graph_upsert(t):
    return grown(t)[1]


@query("graph_upsert_nodes", UPSERT + """ SELECT old.id, old.name, round(coalesce(m.m.v, old.v)[1], 6) AS first_component, false AS is_new FROM old LEFT JOIN m ON m.m.id = old.id
    UNION ALL SELECT m.id, m.name, round(m.v[1], 6), true FROM m WHERE m.is_new""")
def graph_upsert_nodes(t):
    return grown(t)[0].select("id", "name", F.round(F.col("embedding")[0], 6).alias("first_component"), "is_new")


@query("graph_entities", """SELECT doc_id AS id, 0 AS call_no, 0 AS entity_no, source AS entity, CASE WHEN doc_id % 5 = 0 THEN 'A' END AS entity_type FROM documents WHERE doc_id % 5 IN (0, 1, 2)
    UNION ALL SELECT doc_id, 1, 1, lang, 'B' FROM documents WHERE doc_id % 5 = 2""")
def graph_entities(t):
    """A single object, a text of arguments, two calls with something else among their entities, no list, no JSON."""
    payload = F.expr("""CASE doc_id % 5 WHEN 0 THEN concat('{"tool_calls": [{"arguments": {"entities": {"entity": "', source, '", "entity_type": "A"}}}]}')
        WHEN 1 THEN concat('{"tool_calls": [{"arguments": "{\\\\"entities\\\\": [{\\\\"entity\\\\": \\\\"', source, '\\\\"}]}"}]}')
        WHEN 2 THEN concat('{"tool_calls": [{"arguments": {"entities": [{"entity": "', source, '"}, "x", 5]}}, {"arguments": {"entities": [{"entity": "', lang, '0"}, {"entity": "', lang, '", "entity_type": "B"}]}}]}')
        WHEN 3 THEN '{"tool_calls": {"arguments": 1}}' ELSE 'no json' END""")
    found = graph.extracted(t("documents").select(F.col("doc_id").alias("id"), payload.alias("payload")))
    return found.where("NOT (call_no = 1 AND entity_no = 0)")
