"""Streams with state, stopped and gone on with between batches, against folds over the whole."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import jobs, state

ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(*ROCKS)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(ROCKS[0])
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def drop_files(spark, rows, schema, folder, by):
    """A file for each value of the column ``by``, in turn."""
    for k, at in enumerate(sorted({r[by] for r in rows})):
        yield spark.createDataFrame([r for r in rows if r[by] == at], schema).coalesce(1).write.mode("append").parquet(str(folder / f"{k:03d}"))


def run(spark, make, tmp, source, schema):
    """One query from its checkpoint over what is there now."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp / "checkpoint")).option("path", str(tmp / "out")).trigger(availableNow=True).start().awaitTermination()


POLLS = "path string, size long, mtime long, at long"


def polls():
    draw, out = random.Random(4), []
    look = {f"f{i}": [draw.randrange(3), 1] for i in range(10)}
    for at in range(6000, 6720, 60):
        for path, now in look.items():
            if draw.random() < 0.12:
                now[0], now[1] = draw.randrange(3), at
            if path != "f3" or at < 6240:  # f3 goes
                out.append((path, now[0], now[1], at))
    return out


def test_settled_files_of_a_stream_that_is_killed_between_polls(spark, tmp_path):
    rows = polls()
    source = tmp_path / "polls"
    source.mkdir()
    for k, _ in enumerate(drop_files(spark, rows, POLLS, source, 3)):
        if k in (3, 6, 11):  # killed and started again between these polls
            run(spark, lambda s: state.settling(s, 120, 300), tmp_path, source, POLLS)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    at = F.timestamp_seconds("at").alias("ts")
    rested = jobs.settled(spark.createDataFrame(rows, POLLS).select("path", at, "size", "mtime"), "path", "ts", ["size", "mtime"], 120)
    rested = {(r.path, int(r.s)) for r in rested.select("path", F.unix_seconds("ts").alias("s")).collect()}
    by = {(p, t): (s, m) for p, s, m, t in rows}
    first = {(p, "ready", *by[p, t], t) for p, t in rested if by[p, t][0] > 0 and not any((p, u) in rested and by[p, u] == by[p, t] for u in range(6000, t, 60))}
    assert len(first) > 4 and sorted(g for g in got if g[1] == "ready") == sorted(first)
    last = max(t for p, _, _, t in rows if p == "f3")
    assert [g for g in got if g[1] == "gone"] == [("f3", "gone", *by["f3", last], last)]


def test_jobs_are_tried_again_when_due(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    events = [("a", "started", 0), ("a", "failed", 10), ("b", "started", 10), ("a", "started", 50), ("b", "done", 60), ("b", "done", 60), ("c", "started", 70),
              ("a", "started", 200), ("a", "failed", 210), ("x", "started", 460), ("a", "started", 460), ("a", "failed", 470), ("x", "done", 5000), ("a", "started", 5001), ("x", "done", 9000)]
    events = [(job, event, 10_000 + at) for job, event, at in events]
    for k, _ in enumerate(drop_files(spark, events, "job string, event string, at long", source, 2)):
        if k % 3 == 2:
            run(spark, state.trying, tmp_path, source, "job string, event string, at long")
    run(spark, state.trying, tmp_path, source, "job string, event string, at long")
    got = sorted(((r.job, r.state, r.attempts, r.at - 10_000) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[3], r[2], r[1] != "due"))
    assert [r[1:] for r in got if r[0] == "a"] == [("running", 1, 0), ("retry", 1, 10), ("due", 1, 130), ("running", 2, 200), ("retry", 2, 210), ("due", 2, 450), ("running", 3, 460), ("failed", 3, 470)]
    assert [r[1:] for r in got if r[0] in "bc"] == [("running", 1, 10), ("done", 1, 60), ("running", 1, 70)]


def test_folds_survive_a_crash_within_a_batch(spark, tmp_path):
    source, folder = tmp_path / "polls", str(tmp_path / "table")
    source.mkdir()
    rows = polls()
    for _ in drop_files(spark, rows, POLLS, source, 3):
        pass
    schema = "path string, size long, mtime long, since long, present boolean, ready boolean"
    crash = {"at": 7}

    def step(table, batch):
        now = batch.agg(F.max("at")).first()[0]
        if crash["at"] and now >= 6000 + 60 * crash["at"]:
            crash["at"] = 0
            raise RuntimeError("killed")
        return jobs.poll(table, batch.select("path", "size", "mtime"), F.lit(now)).select("path", "size", "mtime", "since", "present", "ready")

    def start():
        stream = spark.readStream.schema(POLLS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
        state.folded(stream, folder, schema, step, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        start()
    start()
    plain = spark.createDataFrame([], schema)
    for at in sorted({r[3] for r in rows}):
        plain = spark.createDataFrame(jobs.poll(plain, spark.createDataFrame([r for r in rows if r[3] == at], POLLS).drop("at"), F.lit(at)).select("path", "size", "mtime", "since", "present", "ready").collect(), schema)
    assert sorted(map(tuple, state.latest(spark, folder, schema).collect())) == sorted(map(tuple, plain.collect()))
