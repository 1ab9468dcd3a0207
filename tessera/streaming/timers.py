"""Streams with timers and state that ends: idle jobs with re-queue, values that expire, turns published once they are done.

Each operator keeps its state in Spark's state store, so a restarted query goes on where it was.
Rows wait until the watermark has passed them and are then taken in the order of time, so the
output is that of the batch twin whatever the micro-batches; rows later than the watermark's delay are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with timers and lists needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ready(spark: SparkSession) -> None:
    """Sets the state store that these operators need; call before a query starts."""
    spark.conf.set(*STORE)


class InOrder(StatefulProcessor):
    """Hands a key's rows to ``take`` in the order of their time (``ms``), each once the watermark has passed it."""

    rows = "ms long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[self.columns()]
            for ms in batch["ms"].unique():
                self.handle.registerTimer(int(ms) + 1)
            self.waiting.appendList([tuple(x) for x in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], str(x)))
        passed = [x for x in held if x[0] < now]
        if passed:
            self.waiting.clear()
            if len(passed) < len(held):
                self.waiting.appendList(held[len(passed) :])
        out = list(self.take(key, passed, now))
        if out:
            yield pd.DataFrame(out, columns=self.output())

    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.rows.split(", ")]

    def close(self) -> None:
        pass


class IdleJobs(InOrder):
    """State of a user: the last activity, and of each conversation the activity its job was queued for and when the job is due."""

    rows = "ms long, conversation string"

    def __init__(self, seconds: int) -> None:
        self.gap = max(30, seconds) * 1000

    def output(self) -> list[str]:
        return ["user_id", "conversation", "seen_ms", "fired_ms"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.latest = handle.getValueState("latest", "ms long")
        self.due = handle.getMapState("due", "conversation string", "seen long, due long")

    def settle(self, user, until: int) -> Iterator[tuple]:
        """Jobs due before ``until``: they run if the user was idle, else they are queued again."""
        latest = self.latest.get()[0] if self.latest.exists() else None
        for (name,), (seen, due) in sorted((tuple(k), tuple(v)) for k, v in self.due.iterator()):
            while due < until and latest > due - self.gap:
                due += self.gap
            if due < until:
                self.due.removeKey((name,))
                yield (user, name, seen, due)
            else:
                self.due.updateValue((name,), (seen, due))

    def take(self, key, rows, now) -> Iterator[tuple]:
        for ms, name in rows:
            yield from self.settle(key[0], ms)
            self.latest.update((ms,))
            self.due.updateValue((name,), (ms, ms + self.gap))
        yield from self.settle(key[0], now)
        for _, (_, due) in self.due.iterator():
            self.handle.registerTimer(int(due) + 1)


class Expiring(InOrder):
    """State of a key: its value and when it was put. Once that is older than the time to live, a timer clears it."""

    rows = "ms long, value string, put boolean"

    def __init__(self, seconds: int) -> None:
        self.live = seconds * 1000

    def output(self) -> list[str]:
        return ["key", "ms", "value", "hit"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.value = handle.getValueState("value", "value string, ms long")

    def take(self, key, rows, now) -> Iterator[tuple]:
        for ms, value, put in sorted(rows, key=lambda x: (x[0], not x[2], str(x[1]))):
            if put:
                self.value.update((value, ms))
                self.handle.registerTimer(ms + self.live + 1)
                continue
            held = self.value.get() if self.value.exists() else None
            hit = held is not None and held[1] + self.live > ms
            yield (key[0], ms, held[0] if hit else None, hit)
        if self.value.exists() and self.value.get()[1] + self.live < now:
            self.value.clear()


class Publishing(InOrder):
    """State of a message: its pieces while its turn runs. With the last one they are sent as one text, and the state becomes a mark."""

    rows = "ms long, seq long, piece string, last boolean"

    def output(self) -> list[str]:
        return ["message_id", "text", "n_pieces"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pieces = handle.getListState("pieces", "seq long, piece string, last boolean")
        self.sent = handle.getValueState("sent", "sent boolean")

    def take(self, key, rows, now) -> Iterator[tuple]:
        if self.sent.exists() or not rows:
            return
        held = {x[0]: tuple(x) for x in self.pieces.get()} | {seq: (seq, piece, last) for _, seq, piece, last in rows}
        ends = [seq for seq, _, last in held.values() if last]
        if ends and all(seq in held for seq in range(min(ends) + 1)):
            self.pieces.clear()
            self.sent.update((True,))
            yield (key[0], "".join(held[seq][1] or "" for seq in range(min(ends) + 1)), min(ends) + 1)
        else:
            self.pieces.put(list(held.values()))


def _run(rows: DataFrame, key: str, processor: InOrder, schema: str, delay: str) -> DataFrame:
    ready(rows.sparkSession)
    timed = rows.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def idle_jobs(events: DataFrame, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Jobs over idle conversations of ``events`` (user_id, conversation, ts): user_id, conversation, seen_at, fired_at.

    Every activity queues a job of its conversation, due ``seconds`` (at least 30) later; a later
    activity there takes the job's place. A job that comes due while its user has been
    active anywhere within ``seconds`` is queued again for ``seconds`` later; else it runs, once. A batch gives
    the jobs of its whole history, as if time went on without end.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("user_id IS NOT NULL AND conversation IS NOT NULL AND ts IS NOT NULL")
    if events.isStreaming:
        out = _run(rows, "user_id", IdleJobs(seconds), "user_id long, conversation string, seen_ms long, fired_ms long", delay)
        return out.select("user_id", "conversation", F.timestamp_millis("seen_ms").alias("seen_at"), F.timestamp_millis("fired_ms").alias("fired_at"))
    gap = max(30, seconds) * 1000
    acts = rows.select("user_id", "conversation", F.unix_millis("ts").alias("ms")).distinct()
    user = Window.partitionBy("user_id").orderBy("ms")
    gaps = acts.select("user_id", "ms").distinct().select("user_id", F.col("ms").alias("from"), F.lead("ms").over(user).alias("to")).where(f"to IS NULL OR to - from > {gap}")
    queued = acts.withColumn("next", F.lead("ms").over(Window.partitionBy("user_id", "conversation").orderBy("ms")))
    met = queued.join(gaps, "user_id").where("from >= ms AND (next IS NULL OR from < next)")
    met = met.withColumn("fired", F.expr(f"ms + {gap} * greatest(1, ceil((from + {gap} - ms) / {gap}))")).where("to IS NULL OR fired < to")
    jobs = met.groupBy("user_id", "conversation", "ms").agg(F.min("fired").cast("long").alias("fired"))
    return jobs.select("user_id", "conversation", F.timestamp_millis("ms").alias("seen_at"), F.timestamp_millis("fired").alias("fired_at"))


def lookups(rows: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """What each look at a key finds among ``rows`` (key, value, put, ts): key, at, value, hit.

    A row either puts a value or (``put`` false) looks for it; a value is found until ``seconds`` after it
    was put, and a new one takes its place. Puts of the same time come before looks.
    """
    known = rows.where("key IS NOT NULL AND ts IS NOT NULL").select("key", F.col("value").cast("string").alias("value"), F.coalesce("put", F.lit(False)).alias("put"), F.col("ts").cast("timestamp").alias("ts"))
    if rows.isStreaming:
        out = _run(known, "key", Expiring(seconds), f"key {dict(known.dtypes)['key']}, ms long, value string, hit boolean", delay)
        return out.select("key", F.timestamp_millis("ms").alias("at"), "value", "hit")
    order = Window.partitionBy("key").orderBy("ms", F.expr("NOT put"), "value").rowsBetween(Window.unboundedPreceding, -1)
    seen = known.withColumn("ms", F.unix_millis("ts")).withColumn("held", F.last(F.when(F.col("put"), F.struct("value", "ms")), ignorenulls=True).over(order)).where("NOT put")
    hit = F.coalesce(F.col("held.ms") + seconds * 1000 > F.col("ms"), F.lit(False))
    return seen.select("key", F.timestamp_millis("ms").alias("at"), F.when(hit, F.col("held.value")).alias("value"), hit.alias("hit"))


def turns(pieces: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Messages of ``pieces`` (message_id, seq from 0, piece, last, ts) whose turn has ended, once each and whole: message_id, text, n_pieces. A running turn is held back, as is one that lacks a piece."""
    rows = pieces.withColumn("ts", F.col("ts").cast("timestamp")).where("message_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")
    if pieces.isStreaming:
        return _run(rows.select("message_id", F.col("seq").cast("long").alias("seq"), "piece", F.coalesce("last", F.lit(False)).alias("last"), "ts"), "message_id", Publishing(), f"message_id {dict(pieces.dtypes)['message_id']}, text string, n_pieces long", delay)
    each = rows.groupBy("message_id", "seq").agg(F.max_by("piece", F.struct("ts", "piece")).alias("piece"), F.bool_or(F.coalesce("last", F.lit(False))).alias("last"))
    ends = each.where("last").groupBy("message_id").agg(F.min("seq").alias("end"))
    whole = each.join(ends, "message_id").where("seq BETWEEN 0 AND end").groupBy("message_id").agg(F.count("*").alias("n_pieces"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("all"))
    return whole.where("n_pieces = end + 1").select("message_id", F.array_join(F.transform("all", lambda x: F.coalesce(x["piece"], F.lit(""))), "").alias("text"), "n_pieces")
