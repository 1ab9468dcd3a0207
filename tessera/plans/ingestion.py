"""Queries over ingestion bookkeeping and pixel relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import images
from tessera.operators import ingestion as I
from tessera.plans.registry import query


@query("upload_admission", "SELECT p_partkey AS name, p_size * 100 - 2000 AS size, CASE WHEN p_size * 100 - 2000 <= 0 THEN 'empty' WHEN p_size * 100 - 2000 > 2000 THEN 'too_large' ELSE 'accepted' END AS verdict FROM part")
def upload_admission(t):
    return I.admit(t("part").select(F.col("p_partkey").alias("name"), (F.col("p_size") * 100 - 2000).alias("size")), 2000)


ITEMS = """SELECT event_id, user_id AS batch_id, CAST(floor(value) AS BIGINT) % 3 AS k, event_type AS type, CASE WHEN event_type = 'error' THEN 'x' END AS error, ts AS started_at, CASE WHEN event_id % 2 = 0 THEN ts END AS finished_at FROM events"""


def items(t):
    return t("events").select("event_id", F.col("user_id").alias("batch_id"), F.col("event_type").alias("type"), F.when(F.col("event_type") == "error", "x").alias("error"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("finished_at"))


@query("batch_lifecycle", f"SELECT event_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN finished_at IS NOT NULL THEN 'success' WHEN started_at IS NOT NULL THEN 'processing' ELSE 'queued' END AS status FROM ({ITEMS})")
def batch_lifecycle(t):
    return I.lifecycle(items(t)).select("event_id", "status")


@query("batch_summary", f"""WITH s AS (SELECT batch_id, type, CASE WHEN error IS NOT NULL THEN 'error' WHEN finished_at IS NOT NULL THEN 'success' WHEN started_at IS NOT NULL THEN 'processing' ELSE 'queued' END AS status FROM ({ITEMS}))
    SELECT batch_id, CAST(count_if(status = 'queued') AS BIGINT) AS queued, CAST(count_if(status = 'processing') AS BIGINT) AS processing, CAST(count_if(status = 'success') AS BIGINT) AS success, CAST(count_if(status = 'error') AS BIGINT) AS error,
    list_sort(list(DISTINCT type)) AS types, bool_or(status = 'error') AS any_error FROM s GROUP BY batch_id""")
def batch_summary(t):
    return I.batch_summary(I.lifecycle(items(t)))


@query("unsynced_items", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unsynced_items(t):
    return I.unsynced(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("sync_statistics", "SELECT CAST(count_if(turn % 4 = 0) AS BIGINT) AS created, CAST(count_if(turn % 4 = 1) AS BIGINT) AS updated, CAST(count_if(turn % 4 = 2) AS BIGINT) AS errors FROM conversations")
def sync_statistics(t):
    return I.sync_stats(t("conversations").withColumn("change", F.expr("CASE turn % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'error' ELSE 'keep' END")))


@query("items_per_collection", "SELECT collection, count(*) AS n_items FROM (SELECT unnest([source, lang]) AS collection FROM documents) GROUP BY collection")
def items_per_collection(t):
    return I.per_collection(t("documents").select(F.array("source", "lang").alias("collections")))


@query("figure_parents", """WITH d AS (SELECT doc_id, source AS collection, lower(lang) AS k FROM documents), g AS (SELECT collection, k, min(doc_id) AS guess FROM d GROUP BY ALL)
    SELECT doc_id AS figure_id, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE guess END AS doc_id FROM d JOIN g USING (collection, k)""")
def figure_parents(t):
    d = t("documents").select("doc_id", F.col("source").alias("collection"), F.concat(F.lit(" "), F.upper("lang")).alias("title"))
    figures = d.select(F.col("doc_id").alias("figure_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-1).alias("parent_id"), "collection", F.concat("title", F.lit(" - Figure 2")).alias("title"))
    return I.parent_of_figures(figures, d)


@query("type_overrides", "SELECT o_orderkey AS doc_id, coalesce((SELECT arg_max(l_returnflag, l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25), o_orderstatus) AS type FROM orders")
def type_overrides(t):
    outputs = t("lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("ord"))
    return I.type_overrides(t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("type")), outputs)


@query("figure_captions", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Figure ' || doc_id || ' from ' || source || ' (pdf)' ELSE lang END AS caption FROM documents")
def figure_captions(t):
    return t("documents").select("doc_id", I.figure_caption(F.col("source"), F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.col("lang")), F.col("doc_id"), F.lit("pdf")).alias("caption"))


#: Text blocks, some with a caption in them, by document.
BLOCK = """CASE doc_id % 6 WHEN 0 THEN concat('Fig. ', CAST(doc_id AS VARCHAR(9)), 'b: ', text) WHEN 1 THEN concat('see  SCHEME 2 - ', text) WHEN 2 THEN concat('Figure 7: short', chr(10), text) WHEN 3 THEN concat('Chart 1', chr(10), text) WHEN 4 THEN concat('x figure ', CAST(doc_id AS VARCHAR(9)), '. ', substring(text, 1, 40)) ELSE text END"""


@query("caption_labels", rf"""WITH b AS (SELECT doc_id AS page, {BLOCK} AS t FROM documents), m AS (SELECT page, CASE WHEN regexp_matches(t, '{I.CAPTIONS[0]}') THEN 0 ELSE 1 END AS k, regexp_extract(t, '{I.CAPTIONS[0]}', ['a', 'b', 'c']) AS f, regexp_extract(t, '{I.CAPTIONS[1]}', ['a', 'b', 'c']) AS g FROM b WHERE regexp_matches(t, '{I.CAPTIONS[0]}') OR regexp_matches(t, '{I.CAPTIONS[1]}'))
    SELECT page, CASE k WHEN 0 THEN f.a || ' ' || f.b ELSE g.a || ' ' || g.b END AS label, trim(CASE k WHEN 0 THEN f.a || ' ' || f.b || ': ' || f.c ELSE g.a || ' ' || g.b || ': ' || g.c END, ': ') AS caption FROM m""")
def caption_labels(t):
    blocks = t("documents").select(F.col("doc_id").alias("page"), F.lit(0).alias("block"), F.expr(BLOCK.replace("VARCHAR(9)", "STRING")).alias("text"))
    return I.captions_in(blocks).select("page", "label", "caption")


@query("error_reports", "SELECT doc_id, '[ingest] ValueError: ' || substring(text, 1, 200) AS report FROM documents")
def error_reports(t):
    return t("documents").select("doc_id", I.error_report(F.lit("ingest"), F.lit("ValueError"), F.col("text")).alias("report"))


@query("anchored_rows", "SELECT id, CAST(row_number() OVER (ORDER BY coalesce(lower(p.r_name), lower(t.name)), coalesce(p.r_regionkey, t.id), p.r_regionkey IS NOT NULL, lower(t.name), id) AS INTEGER) AS position FROM (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation) t LEFT JOIN region p ON t.parent_id = p.r_regionkey")
def anchored_rows(t):
    from tessera.plans.relational import tree

    return I.anchored(tree(t).withColumnRenamed("name", "title"))


@query("stage_times", "SELECT event_id, round(value, 1) AS ms FROM events")
def stage_times(t):
    return t("events").select("event_id", I.delay(F.col("value")).alias("ms"))


def pixels(t):
    """Parts as one image of 50 columns."""
    return t("part").select(F.expr("p_partkey div 50").alias("y"), (F.col("p_partkey") % 50).alias("x"), F.col("p_size").cast("double").alias("v"))


@query("image_subtract", "SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, CAST(p_size - p_partkey % 50 AS DOUBLE) AS v FROM part")
def image_subtract(t):
    a = pixels(t)
    return images.combine(a, a.select("y", "x", F.col("x").cast("double").alias("v")), "subtract")


@query("image_divide", "SELECT p_partkey // 50 AS y, p_partkey % 50 AS x, round(p_size / nullif(p_partkey % 50 % 3, 0), 6) AS v FROM part")
def image_divide(t):
    a = pixels(t)
    return images.combine(a, a.select("y", "x", (F.col("x") % 3).cast("double").alias("v")), "divide").withColumn("v", F.round("v", 6))


@query("image_clipped_stats", """WITH a AS (SELECT l_returnflag AS image_id, l_quantity * l_quantity AS v FROM lineitem), s AS (SELECT image_id, avg(v) AS m, stddev_pop(v) AS d FROM a GROUP BY 1), b AS (SELECT image_id, v FROM a JOIN s USING (image_id) WHERE abs(v - m) <= 1.5 * d)
    SELECT image_id, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation, count(*) AS n FROM b GROUP BY 1""")
def image_clipped_stats(t):
    p = t("lineitem").select(F.col("l_returnflag").alias("image_id"), (F.col("l_quantity") * F.col("l_quantity")).alias("v"))
    s = images.clipped_stats(p, sigma=1.5, rounds=1)
    return s.select("image_id", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "n")


@query("box_refinement", """WITH b AS (SELECT p_partkey % 10 AS page, p_partkey AS box_id, p_size AS x0, p_size AS y0, p_size + 10 AS x1, p_size + 10 AS y1 FROM part), d AS (SELECT s_suppkey % 10 AS page, s_suppkey % 50 AS px0, s_suppkey % 50 - 2 AS py0, s_suppkey % 50 + 4 AS px1, s_suppkey % 50 + 3 AS py1 FROM supplier)
    SELECT b.page, box_id, coalesce(min(px0), any_value(x0)) AS x0, coalesce(min(py0), any_value(y0)) AS y0, coalesce(max(px1), any_value(x1)) AS x1, coalesce(max(py1), any_value(y1)) AS y1
    FROM b LEFT JOIN d ON b.page = d.page AND px0 < x1 AND px1 > x0 AND py0 < y1 AND py1 > y0 GROUP BY b.page, box_id""")
def box_refinement(t):
    b = t("part").select((F.col("p_partkey") % 10).alias("page"), F.col("p_partkey").alias("box_id"), F.col("p_size").alias("x0"), F.col("p_size").alias("y0"), (F.col("p_size") + 10).alias("x1"), (F.col("p_size") + 10).alias("y1"))
    s = F.col("s_suppkey") % 50
    return images.refine_boxes(b, t("supplier").select((F.col("s_suppkey") % 10).alias("page"), s.alias("px0"), (s - 2).alias("py0"), (s + 4).alias("px1"), (s + 3).alias("py1")))


@query("caption_regions", """WITH c AS (SELECT p_partkey AS page, 0 AS block, CAST(p_size * 7 AS DOUBLE) AS x0, CAST(p_size * 9 AS DOUBLE) AS y0, CAST(p_size * 7 + p_partkey % 90 AS DOUBLE) AS x1, 500.0::DOUBLE AS w FROM part), m AS (SELECT *, greatest(0, x0 - 20) AS l, least(w, x1 + 20) AS r FROM c)
    SELECT page, block, CASE WHEN r - l < 150 THEN greatest(0, (l + r) / 2 - 75) ELSE l END AS x0, greatest(0, y0 - 400) AS y0, CASE WHEN r - l < 150 THEN least(w, (l + r) / 2 + 75) ELSE r END AS x1, y0 - 5 AS y1 FROM m WHERE y0 - 5 > greatest(0, y0 - 400) + 100""")
def caption_regions(t):
    n = F.col("p_size")
    c = t("part").select(F.col("p_partkey").alias("page"), F.lit(0).alias("block"), (n * 7).cast("double").alias("x0"), (n * 9).cast("double").alias("y0"), (n * 7 + F.col("p_partkey") % 90).cast("double").alias("x1"), F.lit(500.0).alias("page_width"))
    return images.caption_regions(c)


@query("upload_batches", """WITH f AS (SELECT o_custkey AS batch_id, o_orderkey AS name, o_orderkey % 7 * 100 AS size, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT batch_id, name, size, CASE WHEN n > 15 THEN 'too_many' WHEN size <= 0 THEN 'empty' WHEN size > 500 THEN 'too_large' ELSE 'accepted' END AS verdict FROM f""")
def upload_batches(t):
    return I.admit_batches(t("orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 7 * 100).alias("size")), 15, 500)
