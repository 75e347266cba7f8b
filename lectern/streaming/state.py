"""Streams with state of their own: files that come to rest, jobs that are tried again, and tables folded batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.streaming.jobs import ATTEMPTS, LONGEST, SETTLE

FILE = "size long, mtime long, since long, seen long, told boolean"
SETTLED = "path string, event string, size long, mtime long, at long"
JOB = "attempts int, state string, due long"
TURNS = "job string, state string, attempts int, at long"


class _Settling(StatefulProcessor):
    """The state of one path: what it looked like, since when, when it was last seen, and whether it was told."""

    def __init__(self, seconds: int, gone: int):
        self.seconds, self.gone = seconds, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.file = handle, handle.getValueState("file", FILE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, mtime, since, seen, told = self.file.get() if self.file.exists() else (None, None, None, None, False)
        out = []
        polls = pd.concat(rows).sort_values("at", kind="stable")
        for r in polls.itertuples(index=False):
            if seen is not None and r.at < seen:
                continue  # a poll that comes late tells nothing new
            if (r.size, r.mtime) != (size, mtime):
                size, mtime, since, told = int(r.size), int(r.mtime), int(r.at), False
            elif not told and r.at - since >= self.seconds and size > 0:
                told = True
                out.append((key[0], "ready", size, mtime, int(r.at)))
            seen = int(r.at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((seen + self.gone) * 1000)
        self.file.update((size, mtime, since, seen, told))
        yield pd.DataFrame(out, columns=["path", "event", "size", "mtime", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, mtime, _, seen, _ = self.file.get()
        self.file.clear()
        yield pd.DataFrame([(key[0], "gone", size, mtime, seen)], columns=["path", "event", "size", "mtime", "at"])

    def close(self) -> None:
        pass


def _clocked(stream: DataFrame, at: str, late: str) -> DataFrame:
    """A stream of seconds with a watermark on them."""
    return stream.withColumn("_ts", F.timestamp_seconds(at)).withWatermark("_ts", late)


def settling(polls: DataFrame, seconds: int = SETTLE, gone: int = 10 * SETTLE, late: str = "0 seconds") -> DataFrame:
    """(path, event, size, mtime, at) from a stream of polls (path, size, mtime, at): ``ready`` once, at the first poll at which a
    file that is not empty has looked the same for ``seconds``, and again after each change; ``gone`` when the polls' clock is
    ``gone`` seconds beyond the last at which it was there. ``at`` is in seconds.

    Each path's state and timer are kept by the stream, so a query that starts again from its checkpoint goes on between the
    same two polls. The clock is that of the polls, not the machine's, so the same polls give the same rows however they
    fall into batches, and polls that come ``late`` within it are put in order.
    """
    rows = _clocked(polls.select("path", "size", "mtime", "at"), "at", late)
    return rows.groupBy("path").transformWithStateInPandas(_Settling(seconds, gone), SETTLED, "Append", "EventTime")


class _Trying(StatefulProcessor):
    """The state of one job: how often it was tried, and when it is due again."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, state, due = self.job.get() if self.job.exists() else (0, "pending", None)
        out = []
        for r in pd.concat(rows).sort_values("at", kind="stable").itertuples(index=False):
            now = int(r.at)
            if state == "retry" and due is not None and now >= due:
                out.append((key[0], "due", attempts, due))
                state, due = "pending", None
            if r.event == "started" and state == "pending":
                attempts, state = attempts + 1, "running"
            elif r.event == "done" and state == "running":
                state = "done"
            elif r.event == "failed" and state == "running":
                state = "failed" if attempts >= self.most else "retry"
                due = now + min(LONGEST, 60 * 2**attempts) if state == "retry" else None
            else:
                continue  # an event that does not fit the state, as one told twice, changes nothing
            out.append((key[0], state, attempts, now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due * 1000)
        self.job.update((attempts, state, due))
        yield pd.DataFrame(out, columns=["job", "state", "attempts", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, state, due = self.job.get()
        if state == "retry":
            self.job.update((attempts, "pending", None))
            yield pd.DataFrame([(key[0], "due", attempts, due)], columns=["job", "state", "attempts", "at"])

    def close(self) -> None:
        pass


def trying(events: DataFrame, most: int = ATTEMPTS, late: str = "0 seconds") -> DataFrame:
    """(job, state, attempts, at) from a stream of (job, event, at), events being started, done and failed: each turn of a job's
    state. A failed job is ``retry``, and ``due`` again 60 * 2^attempts seconds later, an hour at most; after ``most`` attempts
    it is ``failed`` for good. Timers run by the events' clock."""
    rows = _clocked(events.select("job", "event", "at"), "at", late)
    return rows.groupBy("job").transformWithStateInPandas(_Trying(most), TURNS, "Append", "EventTime")


def latest(spark: SparkSession, folder: str, schema: str, below: int | None = None) -> DataFrame:
    """The newest version of a folded table, of those that are written in full, or that before batch ``below``; empty at first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
    whole = {int(p.getName()[1:]): p for p in done if p.getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    known = [k for k in whole if below is None or k < below]
    return spark.read.schema(schema).parquet(whole[max(known)].toString()) if known else spark.createDataFrame([], schema)


def folded(stream: DataFrame, folder: str, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, keep: int = 3):
    """A writer that folds a stream into a table: ``step(table, batch)`` gives the table after each batch, as ``jobs.poll``,
    ``jobs.claims`` and the keyed sinks do.

    Each batch writes a version of its own, named after it. A batch that is run again, as after a crash, starts from the
    version before it and writes the same one again, so each batch counts once. Of older versions ``keep`` stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        step(latest(spark, folder, schema, number), batch).write.mode("overwrite").parquet(f"{folder}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number - keep}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
