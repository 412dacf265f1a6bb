"""Streams over files, against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shale import streaming
from shale.operators import tasks as tk

SCHEMA = "task string, seq long, kind string, at_us long, code int, error string, wait int"


def run(stream, name, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


@pytest.mark.parametrize("cuts", [[0, 150], [0, 7, 40, 41, 150]])
def test_task_states_equal_the_batch_fold(spark, tmp_path, cuts):
    rng = random.Random(4)
    kinds = ["enqueue", "enqueue_reset", "start", "done", "retry", "recover", "odd"]
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), i, rng.choice(kinds), (i + 1) * 1_000_000, 400 + i % 9, f"e{i}" * 700, 60 + i % 5) for i in range(150)]
    events = spark.createDataFrame(rows, SCHEMA)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = events.where((F.col("seq") >= a) & (F.col("seq") < b)).orderBy(F.rand(k))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"states{len(cuts)}"
    run(streaming.task_states(stream, stale_seconds=10**9), name)
    told = spark.table(name).where("why = 'event'").groupBy("task").agg(F.max_by(F.struct(*streaming.STATE_NAMES), "updated_us").alias("s")).select("task", "s.*")
    got = {r.task: tuple(r[1:]) for r in told.collect()}
    micros = [F.unix_micros(c) for c in ("next_run_at", "success_at", "updated_at")]
    batch = tk.fold(events.withColumn("at", F.timestamp_micros("at_us")), ["task"], ["seq"], 16)
    assert got == {r[0]: tuple(r[1:]) for r in batch.select("task", "status", "attempts", "last_status_code", "last_error", *micros).collect()}


def test_timers(spark, tmp_path):
    """By event time: a task that stays running is pending again, and one that waits is told when it may run."""
    e = lambda task, seq, kind, at, wait=60: (task, seq, kind, at * 1_000_000, 500, "x", wait)
    first = [e("stuck", 1, "start", 100), e("waits", 1, "retry", 100), e("ends", 1, "start", 100), e("clock", 1, "enqueue", 100)]
    later = [[e("ends", 2, "done", 130), e("clock", 2, "start", 150)], [e("clock", 3, "done", 220)], [e("clock", 4, "enqueue", 400)], [e("clock", 5, "enqueue", 401)]]
    for i, rows in enumerate([first, *later]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import os
        import time

        for name in os.listdir(f"{tmp_path}/in"):
            if name.endswith(".parquet") and not name.startswith("t"):
                os.rename(f"{tmp_path}/in/{name}", f"{tmp_path}/in/t{i}-{name}")
                os.utime(f"{tmp_path}/in/t{i}-{name}", (time.time() + i, time.time() + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    timed = stream.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", "0 seconds")
    run(streaming.task_states(timed, stale_seconds=100, clock="EventTime"), "timers")
    rows = {(r.task, r.why): r for r in spark.table("timers").where("why <> 'event'").collect()}
    assert set(rows) == {("stuck", "stale"), ("waits", "due")}
    assert rows["stuck", "stale"].status == "pending" and rows["stuck", "stale"].updated_us >= 200_000_000
    assert rows["waits", "due"].next_run_us == 160_000_000 and rows["waits", "due"].attempts == 1


def test_fold_of_small_and_large_keys(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(None if i % 3 == 0 else f"k{i % 11}", i, ["start", "retry", "done", "enqueue"][i * 7 % 4], at + dt.timedelta(seconds=i), 500, f"e{i}", 60) for i in range(300)]
    events = spark.createDataFrame(rows, "task string, seq int, kind string, at timestamp, code int, error string, wait int")
    results = [sorted(map(str, tk.fold(events, ["task"], ["seq"], n).collect())) for n in (1000, 30, 4)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 12


def test_late_rows_do_not_count(spark, tmp_path):
    """Windows are given once the watermark has passed them; a row that comes later than that is dropped."""
    import os
    import time

    at = lambda m: dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    files = [[(at(1), "a"), (at(2), "a"), (at(40), "b")], [(at(41), "b")], [(at(3), "a"), (at(42), "b")], [(at(90), "b")], [(at(91), "b")]]  # 0:03 comes a batch after the watermark of 0:30
    for i, rows in enumerate(files):
        path = f"{tmp_path}/part{i}"
        spark.createDataFrame(rows, "at timestamp, kind string").coalesce(1).write.parquet(path)
        name = next(n for n in os.listdir(path) if n.startswith("part-"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{path}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (time.time() + i, time.time() + i))
    stream = lambda: spark.readStream.schema("at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    shown = lambda df: sorted((r.start.strftime("%H:%M"), r.kind, r["count"]) for r in df.collect())
    tumbling = streaming.finished(streaming.windowed_counts(stream(), "at", "kind", "10 minutes", "5 minutes"), "append")
    assert shown(tumbling) == [("00:00", "a", 2), ("00:40", "b", 3)]
    sliding = streaming.finished(streaming.windowed_counts(stream(), "at", "kind", "10 minutes", "10 minutes", "5 minutes"), "append")
    assert shown(sliding)[:2] == [("00:00", "a", 2), ("00:35", "b", 3)]
    sessions = streaming.finished(streaming.session_counts(stream(), "at", "kind", "20 minutes", "10 minutes"), "append")
    assert shown(sessions) == [("00:01", "a", 2), ("00:40", "b", 3)]
