"""Event streams: latest status, deltas, idle jobs, exactly-once effects, token pieces.

Each function takes a streaming or a batch DataFrame; over all rows both give the same
result. ``run_available`` drives a stream over what is there and returns its output.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in ``path``, with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key by time, ties by id; update mode."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each (``keys``) once; in a stream, duplicates are looked for as far back as ``delay``."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def idle(events: DataFrame, key: str = "user_id", seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """A job for each spell of activity, due ``seconds`` (at least 30) after its last event; append mode once the watermark passes."""
    gap = max(30, seconds)
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", f"{gap} seconds"), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("due_at"), "n")


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by window and type; late events within ``delay`` still count."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def deltas(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, text) whose turn is above the last one sent in their conversation; stateful."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("turn").drop_duplicates("turn")
        new = rows[rows["turn"] > last]
        if len(new):
            state.update((int(new["turn"].max()),))
        yield new[["conv_id", "turn", "text"]]

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, text string", "last long", "append", "NoTimeout")


def accumulate(pieces: DataFrame) -> DataFrame:
    """Message text of its pieces (message_id, seq, piece) in order, with the last usage seen; update mode."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return pieces.groupBy("message_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"))


def on_arrival(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch to ``handle``, which should be idempotent by batch id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append-mode stream over what is available into Parquet at ``path`` and reads it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def as_event(kind: str, **fields) -> str:
    """An event as JSON text with sorted keys."""
    return json.dumps({"type": kind, **fields}, sort_keys=True)


def replayed(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """What a dashboard shows that connects late: the jobs still in progress (snapshot: key, status, ts), then the events; column ``live`` tells them apart. Over batches."""
    old = snapshot.where("status NOT IN ('success', 'error')").withColumn("live", F.lit(False))
    return old.unionByName(events.select(*snapshot.columns).withColumn("live", F.lit(True)))


def replay_then_live(stream: DataFrame, snapshot: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """``replayed`` over a stream: the first micro-batch follows the jobs in progress, later ones come alone."""

    def step(batch: DataFrame, number: int) -> None:
        handle(replayed(snapshot, batch) if number == 0 else batch.select(*snapshot.columns).withColumn("live", F.lit(True)), number)

    return on_arrival(stream, step, checkpoint)


def fresh(cached: DataFrame, now, seconds: int) -> DataFrame:
    """The last value of each key (key, value, ts) that isn't older than ``seconds`` at ``now``; what has expired is as if it were never there."""
    last = cached.groupBy("key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    return last.where(F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)) > now)


def published(pieces: DataFrame) -> DataFrame:
    """Messages (message_id, seq, piece, usage, last) that are complete, once each, with all their pieces; of a message still running nothing is sent."""
    done = pieces.groupBy("message_id").agg(F.bool_or("last").alias("done")).where("done")
    return accumulate(pieces.join(done.select("message_id"), "message_id", "left_semi"))


def read_through(wanted: DataFrame, cached: DataFrame, now, seconds: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The value of each wanted key: the cached one while it is ``fresh``, else ``compute`` of the keys that lack one (key, value); column ``hit`` tells which. The misses are what a cache takes in."""
    have = fresh(cached, now, seconds).select("key", "value")
    keys = wanted.select("key").distinct()
    missing = compute(keys.join(have, "key", "left_anti")).select("key", "value", F.lit(False).alias("hit"))
    return keys.join(have, "key").select("key", "value", F.lit(True).alias("hit")).unionByName(missing)


def accumulate_calls(pieces: DataFrame) -> DataFrame:
    """Tool calls of their pieces (message_id, call, seq, name, arguments) in order: the first name that isn't blank, all arguments joined; update mode."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "arguments")))
    named = F.when(F.trim("name") != "", F.col("seq"))
    return pieces.groupBy("message_id", "call").agg(F.min_by("name", named).alias("name"), F.array_join(F.transform(ordered, lambda x: F.coalesce(x["arguments"], F.lit(""))), "").alias("arguments"))


def current(work: DataFrame, latest: DataFrame) -> DataFrame:
    """Work items (key, version, ...) whose version is still the latest of their key (key, version); stale ones go. A stream of work meets a table of versions."""
    known = latest.groupBy("key").agg(F.max("version").alias("_latest"))
    return work.join(known, "key").where(F.col("version") >= F.col("_latest")).drop("_latest")
