"""Streams with timers and state, over several micro-batches and a restart, against their batch twins."""

import random
from datetime import datetime, timedelta, timezone

from tessera.streaming import events as S
from tessera.streaming import timers as T

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FAR = START + timedelta(days=30)


def at(seconds):
    return START + timedelta(seconds=seconds)


def fed(spark, tmp_path, schema, batches, operator, per_run=2):
    """Output of a stream that gets its files one by one, is stopped and goes on from its checkpoint."""
    out = []
    for i in range(0, len(batches), per_run):
        for j, rows in enumerate(batches[i : i + per_run], i):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = operator(S.files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema), 1))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start()
            query.awaitTermination()
            out.append(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count())
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), out


EVENTS = "user_id long, conversation string, ts timestamp"


def test_idle_jobs_move_wait_and_run_once(spark, tmp_path):
    batches = [
        [(1, "a", at(0)), (2, "x", at(10))],
        [(1, "a", at(200)), (1, "b", at(450))],
        [(3, "z", at(5000))],
        [(9, "end", FAR)],
    ]
    got, counts = fed(spark, tmp_path, EVENTS, batches, lambda s: T.idle_jobs(s, 300, "10 seconds"))
    rows = sorted((r.user_id, r.conversation, r.seen_at.timestamp(), r.fired_at.timestamp()) for r in got.collect())
    t = lambda s: at(s).timestamp()
    # The job of "a" moves to 500, finds its user active at 450 and waits until 800.
    assert rows == [(1, "a", t(200), t(800)), (1, "b", t(450), t(750)), (2, "x", t(10), t(310)), (3, "z", t(5000), t(5300))]
    assert counts == sorted(counts) and counts[0] == 0, "nothing runs before its time"


def test_idle_jobs_equal_their_batch_twin(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(4), r.choice("abc"), at(r.randrange(6000))) for _ in range(120)]
    rows.sort(key=lambda x: x[2])
    batches = [rows[:50], rows[50:90], rows[90:], [(99, "end", FAR)]]
    got, _ = fed(spark, tmp_path, EVENTS, batches, lambda s: T.idle_jobs(s, 120, "5 minutes"))
    want = T.idle_jobs(spark.createDataFrame(rows, EVENTS), 120)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_values_expire(spark, tmp_path):
    schema = "key string, value string, put boolean, ts timestamp"
    r = random.Random(2)
    rows = [(r.choice("ab"), f"v{i}" if r.random() < 0.4 else None, None, at(r.randrange(3000))) for i in range(80)]
    rows = [(k, v, v is not None, ts) for k, v, _, ts in rows] + [("c", None, False, at(5))]
    rows.sort(key=lambda x: x[3])
    got, _ = fed(spark, tmp_path, schema, [rows[:40], rows[40:], [("end", None, False, FAR)], [("end", None, False, FAR + timedelta(days=1))]], lambda s: T.lookups(s, 100, "5 minutes"))
    want = T.lookups(spark.createDataFrame(rows, schema), 100)
    have = sorted((r.key, r.at, str(r.value), r.hit) for r in got.where("key <> 'end'").collect())
    assert have == sorted((r.key, r.at, str(r.value), r.hit) for r in want.collect())
    assert {h for *_, h in have} == {True, False}


def test_turns_are_published_once_after_a_restart_in_their_middle(spark, tmp_path):
    schema = "message_id long, seq int, piece string, last boolean, ts timestamp"
    batches = [
        [(1, 0, "Hel", False, at(0)), (2, 0, "run", False, at(1))],
        [(1, 1, "lo ", False, at(100)), (1, 0, "Hel", False, at(101))],
        [(1, 2, "you", True, at(200)), (3, 1, "gap", True, at(200))],
        [(1, 2, "you", True, at(900))],
        [(99, 0, "", True, FAR)],
    ]
    got, counts = fed(spark, tmp_path, schema, batches, lambda s: T.turns(s, "10 seconds"))
    assert sorted(map(tuple, got.where("message_id < 99").collect())) == [(1, "Hello you", 3)]
    twin = T.turns(spark.createDataFrame([x for b in batches for x in b], schema))
    assert sorted(map(tuple, twin.where("message_id < 99").collect())) == [(1, "Hello you", 3)]
    assert counts[1] == 0, "a running turn is held back"
