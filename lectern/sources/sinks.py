"""Keyed tables and files out: first or last writer wins, insert if absent, immutable tables, ordered exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_writer(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: later ones change nothing."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose keys it does not have, one of each; null keys equal each other."""
    o = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.unionByName(new.dropDuplicates(keys).join(o, on, "left_anti"))


def snapshots(old: DataFrame, new: DataFrame, payload: str) -> DataFrame:
    """Snapshots (source, sha256, payload): a payload that a source gave before is not stored again."""
    return insert_absent(old, new.select("source", F.sha2(payload, 256).alias("sha256"), F.col(payload).alias("payload")), ["source", "sha256"])


def checkpoints(old: DataFrame, new: DataFrame, key: str, cursor: str) -> DataFrame:
    """The furthest cursor of each key."""
    return old.select(key, cursor).unionByName(new.select(key, cursor)).groupBy(key).agg(F.max(cursor).alias(cursor))


def fingerprint(rows: DataFrame) -> str:
    """A hash of a table's rows, whatever their order; one number reaches the driver."""
    lines = rows.select(F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).alias("h"))
    total = lines.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return f"{total.n}:{total.x}:{total.s}"


def write_once(rows: DataFrame, path: str) -> None:
    """Writes an immutable Parquet table. If it is there with the same rows nothing happens; with others it is an error."""
    try:
        rows.write.mode("errorifexists").parquet(path)
    except Exception as problem:
        if "PATH_ALREADY_EXISTS" not in str(problem) and "already exists" not in str(problem):
            raise
        if fingerprint(rows.sparkSession.read.schema(rows.schema).parquet(path)) != fingerprint(rows):
            raise ValueError(f"{path} holds other rows") from problem


def export_lines(rows: DataFrame, path: str, order: list[str], only: str | None = None) -> None:
    """JSON lines in order, range-partitioned, so the files' names follow it; ``only`` the rows that hold."""
    kept = rows if only is None else rows.where(only)
    kept.orderBy(*order).write.mode("overwrite").json(path)


def report(summary: DataFrame, removals: DataFrame, folder: str) -> None:
    """A report: the summary as JSON with sorted names, the removals as CSV with a header, by path."""
    summary.select(*sorted(summary.columns)).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    removals.orderBy("path").write.mode("overwrite").option("header", True).csv(f"{folder}/removals")


def markdown(rows: DataFrame, columns: list[str], order: list[str], most: int = 1000) -> str:
    """A Markdown table of a small result: the same rows give the same bytes; null is ``n/a``, numbers have four places. More
    than ``most`` rows are an error, not a cut."""
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    got = rows.select(*columns).orderBy(*order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows in a report")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got)]) + "\n"


def transfer(tables: dict[str, DataFrame], url: str, properties: dict[str, str], done: set[str] | None = None) -> list[str]:
    """Writes tables to a database in the given order, which must put parents first; those in ``done`` are left out, so a
    broken transfer goes on where it stopped."""
    written = []
    for name, rows in tables.items():
        if name not in (done or set()):
            rows.write.mode("append").jdbc(url, name, properties=properties)
            written.append(name)
    return written
