"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    given = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if given is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="lectern-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given)
        given = sc.getCheckpointDir() or given
    return given


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint: computed once, and again readable after an executor is lost. Shuffle files
    that only made them go at once."""
    shared_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # the plan that runs is made inside the block


_PARKED: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables parked inside the block are deleted at its end; results that read them must be written before."""
    _PARKED.append([])
    try:
        yield
    finally:
        for path in _PARKED.pop():
            delete(spark, path)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are built inside the block go when the query ends, not when the driver's memory is next
    collected; for jobs that cut or write what later steps read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def park_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows as a compressed column table in the shared folder, and the table's folder, for the caller to delete once
    a later table stands in its place."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/parked-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def park(df: DataFrame) -> DataFrame:
    """The same rows as a compressed column table in the shared folder, for wide rows of which later steps read few columns.
    It stays until the block of ``scratch`` around it ends, else with the application's folder."""
    parked, path = park_at(df)
    if _PARKED:
        _PARKED[-1].append(path)
    return parked


def broadcast_within(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is. Call it on cut tables: it counts."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, *by) -> DataFrame:
    """``df`` over as many partitions as shuffles have, by the columns ``by``, else evenly: for rows that stand in few files or
    few bytes and cost much, or become many; Spark joins none of these partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows and bytes of an Arrow batch of texts. Texts run to a megabyte, and a batch is held several times over between the
#: JVM and Python.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def texts(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches for rows that hold whole texts; smaller bounds are kept."""
    conf = df.sparkSession.conf
    for key, most in TEXT_BATCH.items():
        if not 0 < int(conf.get(key).rstrip("bB")) <= most:  # 0 and below: no bound
            conf.set(key, str(most))
    return df
