"""Streaming operators give what their batch equivalents give."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from sparquill.operators import events as V
from sparquill.streaming import replay, stateful, streams

SCHEMA = "id long, ts timestamp, user string, kind string, value long"


@pytest.fixture
def batch(spark):
    start = dt.datetime(2026, 1, 1)
    data = [(i, start + dt.timedelta(minutes=7 * i), "uv"[i % 2], "abc"[i * i % 3], i) for i in range(40)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def stream(spark, batch, tmp_path):
    batch.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_windows(batch, stream):
    made = lambda df: streams.windowed(df, "ts", "1 hour", keys=["kind"], n=F.count("*"))
    assert rows(streams.run_to_end(made(stream), "windows", "complete")) == rows(made(batch))


def test_repeats(batch, stream):
    made = streams.run_to_end(streams.without_repeats(stream, "ts", ["user", "kind"]), "repeats")
    assert made.count() == batch.select("user", "kind").distinct().count()


def test_usage(batch, stream):
    made = lambda df: streams.usage_totals(df.withColumn("call", F.col("id").cast("string")), "call", "kind", "value", "ts")
    assert rows(streams.run_to_end(made(stream), "usage", "complete")) == rows(made(batch))


def test_loops(batch, stream):
    made = streams.run_to_end(streams.loop_alerts(stream, "user", "id", "kind", 6, 3, 5), "loops")
    expected = V.loop_flags(batch, "user", "id", "kind", 6, 3, 5)
    assert rows(made.select("user", "id", "recent", "flag")) == rows(expected.select("user", "id", "recent", "flag"))


def test_journal_replaces_a_retried_batch(spark, stream, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        streams.journal(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 40


def test_stream_join(spark, batch, stream, tmp_path):
    """Two streams against the same join of two tables; rows that are too far apart never meet."""
    right = lambda df: df.select("user", F.col("ts").alias("at"), F.col("id").alias("other"))
    other = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    for within, n in (("10 minutes", 40), ("30 minutes", 188)):
        want = rows(streams.joined_streams(batch, right(batch), "user", "ts", "at", within))
        made = streams.run_to_end(streams.joined_streams(stream, right(other), "user", "ts", "at", within), f"joined_{n}")
        assert rows(made) == want and len(want) == n


def in_steps(spark, tmp_path, parts, make, name):
    """The rows of a stream that gets a file at a time, one restart between all of them."""
    folder = tmp_path / name
    out = []
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        made = make(spark.readStream.schema(part.schema).parquet(f"file://{folder}/in"))
        query = made.writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"file://{folder}/out")


def test_bounded_alerts_against_a_simulation(spark, tmp_path):
    """Counts and evictions of each thread over several batches and restarts."""
    rng = random.Random(3)
    events = [(i, "uvw"[rng.randrange(3)], rng.choice("aaabbcdefgh") if i % 23 else None) for i in range(240)]
    cut = [spark.createDataFrame(rng.sample(events[i : i + 80], 80), "id long, user string, kind string") for i in (0, 80, 160)]
    made = in_steps(spark, tmp_path, cut, lambda df: stateful.bounded_alerts(df, "user", "id", "kind", window=6, loop=(2, 3), often=(4, 6), most=3), "alerts")
    want = []
    for user in "uvw":
        last, counts = [], {}  # a dict keeps its order: the first is the least recently used
        for i, u, kind in events:
            if u != user:
                continue
            if kind is None:
                want.append((user, i, None, 0, 0, None, None, None))
                continue
            last = [*last, kind][-6:]
            counts[kind] = counts.pop(kind, 0) + 1
            gone = next(iter(counts)) if len(counts) > 3 else None
            counts.pop(gone, None)
            flag = lambda n, warn, stop: "stop" if n >= stop else "warn" if n >= warn else None
            want.append((user, i, kind, last.count(kind), counts[kind], flag(last.count(kind), 2, 3), flag(counts[kind], 4, 6), gone))
    assert rows(made) == sorted(want, key=repr) and any(w[-1] for w in want)


def test_bounded_alerts_forget_in_time(spark, tmp_path):
    """With a time to live the query looks at the clock and runs until it is stopped."""
    folder = tmp_path / "ttl"
    seen = []
    for i in range(2):
        spark.createDataFrame([(i, "u", "a")], "id long, user string, kind string").coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        df = spark.readStream.schema("id long, user string, kind string").parquet(f"file://{folder}/in")
        query = stateful.bounded_alerts(df, "user", "id", "kind", ttl="1 second").writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"file://{folder}/ck").start()
        for _ in range(60):
            if len(seen) > i or query.awaitTermination(0.5):
                break
        query.stop()
        time.sleep(1.5)
    assert [r["count"] for r in seen] == [1, 1]


def test_debounce_is_sessions(spark, tmp_path):
    """Out of order within the lateness, over restarts: what the batch operator gives, flags OR-ed, the last payload."""
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    events = [(i, "uvw"[rng.randrange(3)], start + dt.timedelta(minutes=9 * i + rng.randrange(60)), rng.random() < 0.2, f"p{i}" if i % 7 else None) for i in range(120)]
    end = [(999, u, start + dt.timedelta(days=30), False, "end") for u in "uvwx"]
    kinds = "id long, user string, ts timestamp, urgent boolean, note string"
    cut = [spark.createDataFrame(events[i : i + 40], kinds) for i in (0, 40, 80)] + [spark.createDataFrame(end, kinds)]
    made = in_steps(spark, tmp_path, cut, lambda df: stateful.debounced(df, ["user"], "ts", "id", ["id", "note"], ["urgent"], "30 minutes", late="3 hours"), "debounce")
    batch = spark.createDataFrame(events, kinds)
    want = V.sessions(batch, "user", "ts", 1800, "id")
    last = batch.select(F.col("id").alias("last_id"), "note")
    flags = batch.join(want.select("user", "session", "start", "end"), "user").where("ts BETWEEN start AND end").groupBy("user", "session").agg(F.bool_or("urgent").alias("urgent"))
    want = want.join(last, "last_id").join(flags, ["user", "session"]).select("user", "start", "end", "n", F.col("last_id").alias("id"), "note", "urgent")
    assert rows(made) == rows(want) and want.count() > 10


def test_replay_log_is_followed_over_restarts(spark, tmp_path):
    """No row twice, none lost; an id to start after, an unknown one, and a reader that fell behind."""
    log, kinds = f"file://{tmp_path}/log", "id string, v long"
    part = lambda a, b: spark.createDataFrame([(f"e{i}", i) for i in range(a, b)], kinds).repartition(3)

    def read(name, after=None):
        out = f"file://{tmp_path}/{name}"
        query = replay.follow(spark, log, kinds, after).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start()
        query.awaitTermination()
        return [(r["log_offset"], r["v"]) for r in spark.read.schema(f"log_offset long, {kinds}").parquet(out).orderBy("log_offset").collect()]

    assert replay.append(part(0, 10), log, "v") == {"first": 0, "next": 10}
    assert read("all") == [(i, i) for i in range(10)]
    replay.append(part(10, 25), log, "v")
    replay.append(part(25, 25), log, "v")  # nothing
    assert read("all") == [(i, i) for i in range(25)] == read("all")
    assert read("after", "e17") == [(i, i) for i in range(18, 25)]
    assert read("late", "e5") == [(i, i) for i in range(6, 25)]
    assert replay.append(part(25, 40), log, "v", most=8) == {"first": 32, "next": 40}
    assert read("all") == [(i, i) for i in [*range(25), *range(32, 40)]]  # it fell behind what is retained
    assert read("unknown", "e3") == [(i, i) for i in range(32, 40)] == read("first")
    assert sum(f.stat().st_size > 0 for f in (tmp_path / "log" / "data").glob("00000000000000000000/part-*")) == 0  # old files are gone


def test_half_an_append_is_not_there(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    replay.append(spark.createDataFrame([("a", 1)], "id string, v long"), log, "v")
    spark.createDataFrame([(1, "x", 2)], "log_offset long, id string, v long").write.parquet(f"{log}/data/{1:020d}")  # files, no head
    rows_of = lambda name: [r["id"] for r in streams.run_to_end(replay.follow(spark, log, "id string, v long"), name).collect()]
    assert rows_of("half") == ["a"]
    replay.append(spark.createDataFrame([("b", 1)], "id string, v long"), log, "v")
    assert sorted(rows_of("whole")) == ["a", "b"]
