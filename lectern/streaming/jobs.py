"""Queues of files and jobs: settling, claims, retries, publication, cursors and quotas, as folds over tables of polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a file must rest, attempts of a job, and the longest wait between them.
SETTLE, ATTEMPTS, LONGEST = 120, 3, 3600


def poll(state: DataFrame, seen: DataFrame, now: Column, settle: int = SETTLE) -> DataFrame:
    """(path, size, mtime, since, present, ready): the state after a poll (path, size, mtime). A file that is new or changed
    starts to rest; one that has rested ``settle`` seconds and is not empty is ready; one that is gone stays, not present.
    For ``foreachBatch`` over a stream of polls: the state is a keyed table that the next poll reads."""
    old = state.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("since").alias("_since"))
    both = old.join(seen.withColumn("_there", F.lit(True)), "path", "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    there = F.coalesce("_there", F.lit(False))
    since = F.when(there & ~same, now).otherwise(F.col("_since"))
    pick = lambda c: F.when(there, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    out = both.select("path", pick("size"), pick("mtime"), since.alias("since"), there.alias("present"), (there & same).alias("_same"))
    return out.withColumn("ready", F.col("present") & F.col("_same") & (now - F.col("since") >= settle) & (F.col("size") > 0)).drop("_same")


def settled(polls: DataFrame, key: str, ts: str, signature: list[str], seconds: int = SETTLE) -> DataFrame:
    """(key, ts): the polls at which a file had rested: its signature was the same since a poll ``seconds`` or more before."""
    order = Window.partitionBy(key).orderBy(ts)
    same = F.struct(*signature).eqNullSafe(F.lag(F.struct(*signature)).over(order))
    runs = polls.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    first = F.min(ts).over(Window.partitionBy(key, "_run"))
    return runs.withColumn("_first", first).where(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp")) >= seconds * 1_000_000).select(key, ts)


def claims(jobs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, id): what each host works on: its running job, else one of the waiting jobs (state pending or retry, due), the
    smallest first, then the one that waits longest; a job goes to one host. As many jobs are ranked as there are hosts."""
    running = jobs.where("state = 'running'").groupBy("host").agg(F.min("id").alias("id"))
    free = hosts.join(running, "host", "left_anti")
    n = free.count()
    waiting = jobs.where("state in ('pending', 'retry') and due").orderBy("size", "updated", "id").limit(n)
    turn = F.row_number().over(Window.orderBy("size", "updated", "id"))
    numbered = free.select("host", F.row_number().over(Window.orderBy("host")).alias("_n"))
    return hosts.join(running, "host").select("host", "id").union(numbered.join(waiting.withColumn("_n", turn), "_n").select(numbered["host"], "id"))


def failed(attempts: Column, most: int = ATTEMPTS) -> Column:
    """The state of a job after a failure: failed after ``most`` attempts, else retry."""
    return F.when(attempts >= most, "failed").otherwise("retry")


def wait_seconds(attempts: Column) -> Column:
    """Seconds until the next attempt: 60 * 2^attempts, an hour at most."""
    return F.least(F.lit(float(LONGEST)), 60 * F.pow(F.lit(2.0), attempts)).cast("long")


def publication(jobs: DataFrame, now: Column, settle: int = SETTLE) -> DataFrame:
    """``jobs`` with ``outcome`` by the first that holds: errors (the wait after an error is not over), superseded (the source
    is no longer that of the job), settling (something watched changed too lately), unchanged (done under the same key),
    published."""
    outcome = (F.when(F.coalesce(F.col("retry_at") > now, F.lit(False)), "errors").when(~F.coalesce(F.col("sha256") == F.col("source_sha256"), F.lit(False)), "superseded")
               .when(now - F.col("touched") < settle, "settling").when(F.coalesce(F.col("done_key") == F.col("key"), F.lit(False)), "unchanged").otherwise("published"))
    return jobs.withColumn("outcome", outcome)


def next_batch(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The rows behind a cursor, ``size`` at most, by key; the largest key is the next cursor."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def within_quota(calls: DataFrame, adapter: str, ts: str, order: str, cap: int) -> DataFrame:
    """``calls`` with ``allowed``: whether a call is among the first ``cap`` of its adapter and month. Days are counted first, so
    only the days in which the cap falls are ranked row by row."""
    month, day = F.date_format(ts, "yyyy-MM"), F.date_format(ts, "yyyy-MM-dd")
    marked = calls.withColumn("_month", month).withColumn("_day", day)
    days = marked.groupBy(adapter, "_month", "_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(adapter, "_month").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(adapter, "_month", "_day").orderBy(ts, order))
    joined = marked.join(days.withColumn("_before", before), [adapter, "_month", "_day"]).withColumn("allowed", F.col("_before") + rank <= cap)
    return joined.drop("_month", "_day", "_n", "_before")
