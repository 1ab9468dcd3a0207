"""Queries over usage events, trees, permissions and the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access
from tessera.operators.chunking import progress
from tessera.operators.ordering import ranked
from tessera.plans.registry import query

#: Regions and nations as a collection tree; grants of customers' keys on it.
TREE = "SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation"
GRANTS = """SELECT c_custkey AS grant_id, c_custkey % 40 AS user_id, CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 5 ELSE 100 + c_nationkey END AS collection_id,
    CASE c_custkey % 3 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'EDIT' ELSE 'MANAGE' END AS permission FROM customer"""
UP = "up(id, ancestor_id, depth) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT up.id, tree.parent_id, depth + 1 FROM up JOIN tree ON tree.id = up.ancestor_id WHERE tree.parent_id IS NOT NULL)"


def tree(t):
    regions = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    return regions.union(t("nation").select((100 + F.col("n_nationkey")).cast("long"), F.col("n_regionkey").cast("long"), "n_name"))


def grants(t):
    """Those that ``GRANTS`` has."""
    return t("customer").select(
        F.col("c_custkey").alias("grant_id"), (F.col("c_custkey") % 40).alias("user_id"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 5 ELSE 100 + c_nationkey END").alias("collection_id"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'EDIT' ELSE 'MANAGE' END").alias("permission"),
    )


@query("access_direct", f"SELECT DISTINCT user_id, collection_id FROM ({GRANTS}) WHERE permission IN ('EDIT', 'MANAGE')")
def access_direct(t):
    return access.direct(grants(t), "EDIT")


@query("access_inherited", f"WITH RECURSIVE tree AS ({TREE}), g AS ({GRANTS}), {UP} SELECT DISTINCT g.user_id, up.id AS collection_id FROM up JOIN g ON g.collection_id = up.ancestor_id WHERE permission = 'MANAGE'")
def access_inherited(t):
    return access.inherited(tree(t), grants(t), "MANAGE")


@query("access_source", f"WITH RECURSIVE tree AS ({TREE}), g AS ({GRANTS}), {UP} SELECT id, arg_min(ancestor_id, depth) AS source_id FROM up WHERE ancestor_id IN (SELECT collection_id FROM g) GROUP BY id")
def access_source(t):
    return access.permission_source(tree(t), grants(t))


@query("access_owner", f"SELECT collection_id, arg_min(user_id, grant_id) AS owner_id FROM ({GRANTS}) WHERE permission = 'MANAGE' GROUP BY collection_id")
def access_owner(t):
    return access.owners(grants(t))


@query("access_latest_grant", f"SELECT user_id, collection_id, max(grant_id) AS grant_id, arg_max(permission, grant_id) AS permission FROM ({GRANTS}) GROUP BY ALL")
def access_latest_grant(t):
    return access.latest_grants(grants(t))


@query("access_documents", f"""SELECT d.doc_id, g.user_id FROM documents d JOIN (SELECT DISTINCT user_id, collection_id FROM ({GRANTS})) g ON 'src' || (g.collection_id - 100) = d.source""")
def access_documents(t):
    g = access.direct(grants(t), "VIEW").select("user_id", F.concat(F.lit("src"), F.col("collection_id") - 100).alias("source"))
    return t("documents").join(g, "source").select("doc_id", "user_id")


@query("access_viewers_only", f"""SELECT user_id, collection_id FROM ({GRANTS}) WHERE permission = 'VIEW' EXCEPT SELECT user_id, collection_id FROM ({GRANTS}) WHERE permission IN ('EDIT', 'MANAGE')""")
def access_viewers_only(t):
    return access.viewers_only(grants(t))


@query("access_mirror", f"""WITH g AS (SELECT user_id, collection_id, arg_max(permission, grant_id) AS permission FROM ({GRANTS}) GROUP BY ALL), a AS (SELECT * FROM g WHERE collection_id = 101), b AS (SELECT * FROM g WHERE collection_id = 102)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.permission AS want, b.permission AS have, CASE WHEN b.user_id IS NULL THEN 'insert' WHEN a.user_id IS NULL THEN 'delete' ELSE 'update' END AS change
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.permission IS DISTINCT FROM b.permission""")
def access_mirror(t):
    g = access.latest_grants(grants(t))
    return access.mirror(g.where("collection_id = 101"), g.where("collection_id = 102")).select("user_id", "want", "have", "change")


@query("tree_paths", f"""WITH RECURSIVE tree AS ({TREE}), {UP} SELECT up.id, string_agg(t.name, '/' ORDER BY depth DESC) AS path, max(depth) AS depth FROM up JOIN tree t ON t.id = up.ancestor_id GROUP BY up.id""")
def tree_paths(t):
    return access.paths(tree(t))


@query("tree_descendants", f"WITH RECURSIVE tree AS ({TREE}), {UP} SELECT ancestor_id AS id, id AS descendant_id, depth FROM up WHERE depth > 0")
def tree_descendants(t):
    return access.ancestors(tree(t)).where("depth > 0").select(F.col("ancestor_id").alias("id"), F.col("id").alias("descendant_id"), "depth")


@query("tree_cycle_check", f"WITH RECURSIVE tree AS ({TREE}), {UP}, w AS (SELECT id, (id * 3) % 5 AS new_parent_id FROM tree UNION ALL SELECT n_regionkey, 100 + n_nationkey FROM nation) SELECT w.id, new_parent_id, EXISTS (SELECT 1 FROM up WHERE up.id = new_parent_id AND ancestor_id = w.id) AS cycle FROM w")
def tree_cycle_check(t):
    wanted = tree(t).select("id", ((F.col("id") * 3) % 5).alias("new_parent_id")).union(t("nation").select(F.col("n_regionkey").cast("long"), (100 + F.col("n_nationkey")).cast("long")))
    return access.moves(tree(t), wanted)


@query("tree_item_counts", f"""WITH RECURSIVE tree AS ({TREE}), {UP}, p AS (SELECT up.id, string_agg(t.name, '/' ORDER BY depth DESC) AS path, max(depth) AS depth FROM up JOIN tree t ON t.id = up.ancestor_id GROUP BY up.id)
    SELECT p.*, (SELECT count(*) FROM supplier WHERE 100 + s_nationkey = p.id) AS n_items FROM p""")
def tree_item_counts(t):
    return access.counted_tree(tree(t), t("supplier").select((100 + F.col("s_nationkey")).cast("long").alias("collection_id")))


@query("usage_totals", "SELECT CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CASE WHEN event_type = 'none' THEN 1 END) AS BIGINT) AS nothing FROM events")
def usage_totals(t):
    return t("events").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.when(F.col("event_type") == "none", 1)).alias("nothing"))


@query("usage_cost", "SELECT event_id, round(CAST(CAST(floor(value) AS DOUBLE) / 1000 * CAST(0.0005 AS DOUBLE) + CAST(user_id AS DOUBLE) / 1000 * CAST(0.0015 AS DOUBLE) AS DOUBLE), 9) AS cost FROM events WHERE value IS NOT NULL")
def usage_cost(t):
    return t("events").where("value IS NOT NULL").select("event_id", F.round(T.cost(F.floor("value"), F.col("user_id")), 9).alias("cost"))


@query("usage_running_cost", "SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def usage_running_cost(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", "user_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("running"))


@query("status_counts", "SELECT user_id, CAST(count_if(event_type = 'signup') AS BIGINT) AS signup, CAST(count_if(event_type = 'purchase') AS BIGINT) AS purchase, CAST(count_if(event_type = 'error') AS BIGINT) AS error, CAST(count_if(event_type = 'missing') AS BIGINT) AS missing FROM events GROUP BY user_id")
def status_counts(t):
    return t("events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == s).alias(s) for s in ("signup", "purchase", "error", "missing")))


@query("type_sets", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS types, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id")
def type_sets(t):
    return t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


def upper_median_of(rows, key, value):
    """The value in the middle of each key's, the upper of two: all rows are ranked by key and value over ranges, so no key's values meet in one task."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(key, value), key, value)
    middle = placed.groupBy(key).agg((F.min("rank") + F.floor(F.count("*") / 2)).alias("rank"))
    return placed.join(middle.select("rank"), "rank").select(key, F.col(value).alias("median"))


@query("upper_median", "SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY event_type")
def upper_median(t):
    return upper_median_of(t("events"), "event_type", "value")


@query("page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(t):
    o = t("orders")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@query("user_search", "SELECT DISTINCT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'auto')) AND c_custkey <> 12")
def user_search(t):
    return t("customer").where("(contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'auto')) AND c_custkey <> 12").select("c_custkey", "c_name").distinct()


@query("left_join_user", "SELECT o_orderkey, coalesce(c_name, 'anonymous') AS reporter FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def left_join_user(t):
    c = t("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return t("orders").join(c, F.expr("o_custkey = c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("anonymous")).alias("reporter"))


@query("message_owner_join", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def message_owner_join(t):
    return t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("related_top3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3")
def related_top3(t):
    return access.nearest_wins(t("lineitem").where("l_quantity >= 10"), "l_orderkey", "l_linenumber", 3).select("l_orderkey", "l_linenumber")


@query("related_visible", """WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), v AS (SELECT * FROM n WHERE n <= 9 AND c_custkey % 4 = 1)
    SELECT c_nationkey, c_custkey FROM v QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3""")
def related_visible(t):
    return access.related(t("customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", F.col("c_custkey") % 4 == 1)


@query("id_prefix_join", """WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS hex FROM documents), q AS (SELECT substring(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS prefix FROM documents WHERE doc_id % 10 = 0)
    SELECT prefix, min(doc_id) AS doc_id FROM q JOIN h ON starts_with(hex, prefix) GROUP BY prefix HAVING count(*) = 1""")
def id_prefix_join(t):
    h = t("documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("hex"))
    q = h.where("doc_id % 10 = 0").select(F.substring("hex", 1, 16).alias("prefix"))
    # Prefixes have 16 digits at least, so they meet on those before the full test.
    hit = q.join(h.withColumn("prefix", F.substring("hex", 1, 16)), "prefix").where("startswith(hex, prefix)")
    return hit.groupBy("prefix").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("progress_changes", """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(floor(100.0 * l_linenumber / 7) AS BIGINT) AS percent, lag(CAST(floor(100.0 * l_linenumber / 7) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, percent FROM p WHERE b IS NULL OR b <> percent""")
def progress_changes(t):
    return progress(t("lineitem").select("l_orderkey", "l_linenumber", F.lit(7).alias("total")), "l_orderkey", "l_linenumber", "l_linenumber", "total").select("l_orderkey", "l_linenumber", "percent")


@query("iso_times", "SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || 'Z' AS iso FROM events")
def iso_times(t):
    return t("events").select("event_id", T.iso_utc(F.col("ts")).alias("iso"))


@query("json_probe", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events")
def json_probe(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("k"))


@query("cache_keys", """SELECT doc_id, 'rag:' || CASE WHEN length(b) > 180 THEN sha256(b) ELSE b END AS key FROM (SELECT doc_id, '["' || doc_id || '","' || source || '"]' AS b FROM documents)""")
def cache_keys(t):
    return t("documents").select("doc_id", T.cache_key("rag", F.col("doc_id"), F.col("source")).alias("key"))


@query("uuid_repair", "SELECT doc_id, CASE WHEN n >= 28 THEN regexp_replace(rpad(substring(h, 1, n), 32, '0'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS uuid FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, CAST(27 + doc_id % 6 AS INTEGER) AS n FROM documents)")
def uuid_repair(t):
    raw = F.concat(F.lit("<b>"), F.substring(F.md5(F.col("doc_id").cast("string")), F.lit(1), (27 + F.col("doc_id") % 6).cast("int")), F.lit("</b>"))
    return t("documents").select("doc_id", T.repair_uuid(raw).alias("uuid"))


@query("clock_text", "SELECT event_id, lpad(CAST(CAST(floor(value) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((CAST(floor(value) AS BIGINT) % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM events WHERE value >= 0")
def clock_text(t):
    return t("events").where("value >= 0").select("event_id", T.clock(F.col("value")).alias("clock"))


# What the reference leaves to its database, free in Spark.
@query("rollup_sales", "SELECT n_name, o_orderpriority, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")
def rollup_sales(t):
    rows = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.rollup("n_name", "o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100)).cast("long").alias("cents"), F.count("*").alias("n"))


@query("cube_events", "SELECT event_type, user_id % 5 AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 5)")
def cube_events(t):
    return t("events").withColumn("shard", F.col("user_id") % 5).cube("event_type", "shard").agg(F.count("*").alias("n"))


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(t):
    return t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("idle_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 300 SECOND AS fires_at, count(*) AS n FROM s GROUP BY user_id, s""")
def idle_sessions(t):
    return t("events").groupBy("user_id", F.session_window("ts", "300 seconds")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("fires_at"), "n")


@query("set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def set_operations(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey")).subtract(t("nation").where("n_regionkey = 2").select("n_nationkey"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY ALL""")
def pricing_summary(t):
    return t("lineitem").where("l_quantity < 40").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"), F.count("*").alias("n"))
