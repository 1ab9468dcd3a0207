"""Batch twins of the event streams; tests compare them with the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import events as S
from tessera.streaming import timers


@query("stream_latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at, count(*) AS n FROM events GROUP BY user_id")
def stream_latest_status(t):
    return S.latest_status(t("events"))


@query("stream_once", "SELECT DISTINCT user_id, event_type FROM events")
def stream_once(t):
    return S.once(t("events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("stream_idle_jobs", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 900 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 900 SECOND AS due_at, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_idle_jobs(t):
    return S.idle(t("events"), seconds=900)


@query("stream_token_pieces", "SELECT doc_id AS message_id, text, doc_id * 10 + 2 AS usage FROM documents WHERE length(text) >= 3")
def stream_token_pieces(t):
    d = t("documents").where("length(text) >= 3").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    third = F.expr("length(text) div 3")
    piece = F.expr("CASE WHEN k = 2 THEN substring(text, 2 * (length(text) div 3) + 1) ELSE substring(text, k * (length(text) div 3) + 1, length(text) div 3) END")
    usage = F.when(F.col("k") > 0, F.col("doc_id") * 10 + F.col("k"))
    return S.accumulate(d.where(third > 0).select(F.col("doc_id").alias("message_id"), F.col("k").alias("seq"), piece.alias("piece"), usage.alias("usage")))


@query("stream_replay", """SELECT user_id AS key, event_type AS status, ts, live FROM (SELECT user_id, event_type, ts, false AS live FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' UNION ALL SELECT user_id, event_type, ts, true FROM events WHERE event_id % 2 = 1)""")
def stream_replay(t):
    e = t("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), "ts", "event_id")
    return S.replayed(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1"))


@query("stream_fresh", """WITH l AS (SELECT user_id AS key, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id) SELECT * FROM l WHERE ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-31 00:00:00'""")
def stream_fresh(t):
    return S.fresh(t("events").select(F.col("user_id").alias("key"), "value", "ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 86_400)


@query("stream_published", "SELECT doc_id AS message_id, text, doc_id AS usage FROM documents WHERE doc_id % 3 = 0 AND length(text) >= 2")
def stream_published(t):
    """Messages in two pieces; of two thirds the closing one hasn't come."""
    d = t("documents").where("length(text) >= 2").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    piece = F.expr("CASE WHEN k = 0 THEN left(text, length(text) div 2) ELSE substring(text, length(text) div 2 + 1) END")
    return S.published(d.select(F.col("doc_id").alias("message_id"), F.col("k").alias("seq"), piece.alias("piece"), F.when(F.col("k") == 1, F.col("doc_id")).alias("usage"), ((F.col("k") == 1) & (F.col("doc_id") % 3 == 0)).alias("last")))


@query("cache_read_through", """WITH l AS (SELECT user_id AS key, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id), f AS (SELECT key, value FROM l WHERE ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-31 00:00:00')
    SELECT c_custkey AS key, coalesce(value, CAST(c_custkey AS DOUBLE)) AS value, value IS NOT NULL AS hit FROM customer LEFT JOIN f ON key = c_custkey""")
def cache_read_through(t):
    cached = t("events").select(F.col("user_id").alias("key"), "value", "ts")
    return S.read_through(t("customer").select(F.col("c_custkey").alias("key")), cached, F.lit("2024-01-31 00:00:00").cast("timestamp"), 86_400, lambda keys: keys.withColumn("value", F.col("key").cast("double")))


@query("stream_call_pieces", """SELECT doc_id AS message_id, 0 AS call, 'vector_search' AS name, '{"q": "' || source || '"}' AS arguments FROM documents UNION ALL SELECT doc_id, 1, NULL, lang FROM documents WHERE doc_id % 2 = 0""")
def stream_call_pieces(t):
    """A call in three pieces, its name in the second, and one that never got a name."""
    d = t("documents")
    part = lambda k, call, name, text, where="true": d.where(where).selectExpr("doc_id AS message_id", f"{call} AS call", f"{k} AS seq", f"{name} AS name", f"{text} AS arguments")
    pieces = part(2, 0, "''", "'\"}'").union(part(0, 0, "'  '", "'{\"q\": \"'")).union(part(1, 0, "'vector_search'", "source")).union(part(0, 1, "CAST(NULL AS STRING)", "lang", "doc_id % 2 = 0"))
    return S.accumulate_calls(pieces)


@query("stream_current_work", "SELECT user_id AS key, event_id AS version FROM events WHERE event_id IN (SELECT max(event_id) FROM events WHERE event_type <> 'error' GROUP BY user_id)")
def stream_current_work(t):
    e = t("events").where("event_type <> 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"))
    return S.current(e, e)


@query("stream_requeued_jobs", """WITH RECURSIVE a AS MATERIALIZED (SELECT DISTINCT user_id, event_type AS c, epoch_us(ts) // 1000 AS ms FROM events), q AS (SELECT *, lead(ms) OVER (PARTITION BY user_id, c ORDER BY ms) AS nxt FROM a),
    j(user_id, c, ms, nxt, f) AS (SELECT user_id, c, ms, nxt, ms + 21600000 FROM q
        UNION ALL SELECT user_id, c, ms, nxt, f + 21600000 FROM j WHERE (nxt IS NULL OR f < nxt) AND EXISTS (SELECT 1 FROM a WHERE a.user_id = j.user_id AND a.ms > f - 21600000 AND a.ms <= f))
    SELECT user_id, c AS conversation, make_timestamp(ms * 1000) AS seen_at, make_timestamp(f * 1000) AS fired_at FROM j
    WHERE (nxt IS NULL OR f < nxt) AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = j.user_id AND a.ms > f - 21600000 AND a.ms <= f)""")
def stream_requeued_jobs(t):
    return timers.idle_jobs(t("events").select("user_id", F.col("event_type").alias("conversation"), "ts"), 21_600).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("seen_at", "fired_at")})


@query("stream_lookups", """WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id % 3 = 0 AS put, CAST(event_id AS VARCHAR) AS value FROM events),
    l AS (SELECT *, last_value(CASE WHEN put THEN struct_pack(value := value, ms := ms) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ms, NOT put, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e)
    SELECT key, make_timestamp(ms * 1000) AS at, CASE WHEN held.ms + 86400000 > ms THEN held.value END AS value, coalesce(held.ms + 86400000 > ms, false) AS hit FROM l WHERE NOT put""")
def stream_lookups(t):
    rows = t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), (F.col("event_id") % 3 == 0).alias("put"), "ts")
    return timers.lookups(rows, 86_400).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("stream_turns", """WITH e AS (SELECT conv_id, min(turn) AS ending FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT conv_id AS message_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_pieces FROM conversations JOIN e USING (conv_id) WHERE turn <= ending GROUP BY conv_id, ending HAVING count(*) = ending + 1""")
def stream_turns(t):
    """Turns stand for pieces; the first of the assistant ends a message."""
    ts = F.timestamp_seconds(F.col("turn") + 1_700_000_000)
    return timers.turns(t("conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"), (F.col("role") == "assistant").alias("last"), ts.alias("ts")))
