"""Continuous forms: the task state machine per key, and the listing merge per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shale import storage
from shale.operators.tasks import ERROR_CHARS
from shale.sources import store

TASK_STATE = "status string, attempts int, last_status_code int, last_error string, next_run_us long, success_us long, updated_us long"
TASK_ROW = f"task string, {TASK_STATE}, why string"
#: Seconds after which a running task counts as left behind.
STALE_SECONDS = 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _next(s: dict, e) -> dict:
    """One transition; the batch form is shale.operators.tasks.transition."""
    running, done, fresh = s["status"] == "running", s["status"] == "done", s["status"] is None
    s = dict(s, updated_us=int(e.at_us))
    if e.kind in ("enqueue", "enqueue_reset"):
        again = e.kind == "enqueue_reset" and not running
        s.update(last_status_code=None, last_error=None, next_run_us=None)
        s["status"] = "running" if running else "done" if done and e.kind == "enqueue" else "pending"
        if fresh or again:
            s["attempts"] = 0
        if again:
            s["success_us"] = None
    elif e.kind == "start":
        s["status"] = "running"
    elif e.kind == "done":
        s.update(status="done", last_status_code=None, last_error=None, next_run_us=None, success_us=int(e.at_us))
    elif e.kind == "retry":
        s.update(status="pending", attempts=(s["attempts"] or 0) + 1, last_status_code=int(e.code), last_error=str(e.error)[:ERROR_CHARS], next_run_us=int(e.at_us) + int(e.wait) * 1_000_000)
    elif e.kind == "recover" and running:
        s["status"] = "pending"
    s["attempts"] = s["attempts"] or 0
    return s


STATE_NAMES = [f.split()[0] for f in TASK_STATE.split(", ")]
#: Transitions of a task that are looked at together.
TOGETHER = 4096


def folded(state: dict, batches: Iterator[pd.DataFrame]) -> dict:
    """state after a task's events, whatever the order of the batches.

    Of all events the numbers are held (some 40 bytes each, of one micro-batch), of the errors only the latest.
    """
    kinds: list[str] = []
    parts, error = [], (None, "")
    for own in batches:
        codes = own["kind"].map(lambda k: kinds.index(k) if k in kinds else (kinds.append(k) or len(kinds) - 1))
        parts.append(np.stack([own["seq"], codes, own["at_us"], own["code"].fillna(0), own["wait"].fillna(0)], axis=1).astype(np.int64))
        retries = own[own["kind"] == "retry"]
        if len(retries):
            last = retries.loc[retries["seq"].idxmax()]
            error = max(error, (int(last["seq"]), str(last["error"] or "")), key=lambda x: -1 if x[0] is None else x[0])
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    for at in range(0, len(rows), TOGETHER):
        for seq, kind, at_us, code, wait in rows[at : at + TOGETHER].tolist():
            state = _next(state, SimpleNamespace(kind=kinds[kind], at_us=at_us, code=code, error=error[1] if seq == error[0] else "", wait=wait))
    return state


class TaskProcessor(StatefulProcessor):
    """A task's state, and one timer for it: when it has been running for too long, or may run again."""

    def __init__(self, stale_seconds: int, clock: str):
        self.stale_us, self.clock = stale_seconds * 1_000_000, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", TASK_STATE)

    def _now(self, timers) -> int:
        ms = timers.getCurrentProcessingTimeInMs() if self.clock == "ProcessingTime" else timers.getCurrentWatermarkInMs()
        return ms * 1000

    def _kept(self, key: tuple, s: dict, why: str, timers) -> Iterator[pd.DataFrame]:
        self.state.update(tuple(s[n] for n in STATE_NAMES))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = s["updated_us"] + self.stale_us if s["status"] == "running" else s["next_run_us"] if s["status"] == "pending" and why != "due" else None
        if due is not None:  # a time that has passed is told at once
            self.handle.registerTimer(max(-(-due // 1000), self._now(timers) // 1000 + 1))
        yield pd.DataFrame([{"task": key[0], **s, "why": why}]).astype({n: "Int64" for n in ("attempts", "last_status_code", "next_run_us", "success_us", "updated_us")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(STATE_NAMES, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(STATE_NAMES)
        yield from self._kept(key, folded(s, rows), "event", timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, now = dict(zip(STATE_NAMES, self.state.get(), strict=True)), self._now(timerValues)
        if s["status"] == "running" and s["updated_us"] + self.stale_us <= now:
            yield from self._kept(key, s | {"status": "pending", "updated_us": now}, "stale", timerValues)
        elif s["status"] == "pending" and s["next_run_us"] is not None and s["next_run_us"] <= now:
            yield from self._kept(key, s, "due", timerValues)


def task_states(events: DataFrame, stale_seconds: int = STALE_SECONDS, clock: str = "ProcessingTime") -> DataFrame:
    """The state of each task after every micro-batch that touches it, and whenever its timer goes off.

    events: task, seq (unique for a task), kind, at_us, code, error, wait. why: 'event'; 'stale', where a task that has been
    running for stale_seconds is pending again; 'due', where a waiting task may run. clock: 'EventTime' goes by the stream's
    watermark. State lives in RocksDB, so it needn't fit in memory.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("task").transformWithStateInPandas(TaskProcessor(stale_seconds, clock), TASK_ROW, "update", clock)


def merge_each(stream: DataFrame, at: str, key: str, sequence: str, checkpoint: str, interval: str | None = "30 seconds", buckets: int = store.BUCKETS):
    """Merges every micro-batch into the store of buckets at `at` (:mod:`shale.sources.store`), one that is there or a new one.

    A batch that runs again after a failure is merged once. The sequence stays a column of the store.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch.withColumn("_at", F.col(sequence)), at, key, "_at", f"{checkpoint}:{number}", buckets, kept=())

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, at: str, by: str, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts of windows, tumbling or sliding, with a watermark: rows that are later than it don't count any more."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, slide).alias("w"), by).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), by, "count")


def session_counts(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of sessions: events of a key that follow each other by less than the gap. A session ends the gap after its last event."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("count"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "count")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream over files gives once all of them are read: its last result ('complete'), or all that it has given ('append')."""
    spark = stream.sparkSession
    at, log = storage.new_path(spark, "stream"), storage.new_path(spark, "stream-log")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{'last' if mode == 'complete' else f'b={number}'}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/last" if mode == "complete" else f"{at}/b=*")
