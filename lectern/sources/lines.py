"""Lines of large text files with their numbers, and a dump staged in batches that can be gone on with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.storage import broadcast_within, cut

#: Where a retailer's record may name itself, the first that is there.
NAMES = ("id", "productId", "sku", "url")


def placed(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): the lines of text files. (path, block, at) grows from line to line: files by name, the parts
    of a file that tasks read by their offset, and the lines of a part in turn."""
    found = spark.read.text(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files of any size, numbered from 1 in each file.

    Files are read in parts by many tasks, twice: first the lines of each part are counted, and added up over the parts of a
    file by offset; then each line's number is what its part starts with and its place there. Both readings must cut
    files in the same way, which Spark does while its settings stay as they are; if they do not, the second fails instead of
    numbering wrongly.
    """
    lines = placed(spark, path)
    parts = cut(lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    place = F.col("at") - F.col("first")
    sure = F.when(place.between(0, F.col("n") - 1), F.col("before") + place + 1).otherwise(F.raise_error(F.lit("files were cut in another way than when their lines were counted")).cast("long"))
    return lines.join(broadcast_within(starts), ["path", "block"], "left").select("path", sure.alias("line"), "value")


def last_of(lines: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value) of the last of the ``placed`` lines with each key; those with a null key are left out."""
    rows = lines.select(key.alias("key"), value.alias("value"), F.struct("path", "block", "at").alias("place")).where("key is not null")
    return rows.groupBy("key").agg(F.max_by("value", "place").alias("value"))


def _classed(lines: DataFrame) -> DataFrame:
    """(line, external_id, title, payload) of a retailer's JSON lines; all but ``line`` null where a line is no book with a title."""
    field = lambda name: F.get_json_object("value", f"$.{name}")
    title = F.trim(F.get_json_object(field("specification"), "$.Title"))
    book = F.coalesce((field("productType") == "book") & (title != ""), F.lit(False))
    name = F.coalesce(*[F.when(field(n) != "", field(n)) for n in NAMES], F.concat(F.lit("line:"), F.col("line").cast("string")))
    return lines.select("line", *[F.when(book, c).alias(n) for n, c in (("external_id", name), ("title", title), ("payload", F.col("value")))])


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """The batches of a staged dump that are written in full."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    done = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(p.toString() for p in done)


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """(line, external_id, title, payload, state) of all batches of a staged dump."""
    schema = "line long, external_id string, title string, payload string, state string"
    done = _batches(spark, folder)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def progress(rows: DataFrame) -> dict[str, int]:
    """The cursor of a staged dump, and how many of its records are staged, skipped (no book with a title, or a broken or empty
    line) or ignored (their name was there before)."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.agg(F.coalesce(F.max("line"), F.lit(0)).alias("cursor"), n("staged"), n("skipped"), n("ignored")).first().asDict()


def stage(spark: SparkSession, path: str, folder: str, batch: int = 50_000_000, most: int | None = None) -> dict[str, int]:
    """Stages a retailer's JSONL dump, ``batch`` lines at a time, and returns its ``progress``.

    A batch is one folder, which is there once it is written in full; what is staged and the cursor to go on from are thus
    one commit. A run that ends early, after any batch or within one, is gone on with by calling this again; ``most`` ends
    it after so many batches. A name is staged once, on its first line; a record without one is named after its line. Each
    batch reads the dump again, so batches should be large.
    """
    lines = numbered(spark, path)
    whole = lines.agg(F.coalesce(F.max("line"), F.lit(0))).first()[0]
    if lines.select("path").distinct().limit(2).count() > 1:
        raise ValueError("a dump is one file: lines are its cursor")
    done = 0
    while (at := progress(staged(spark, folder))["cursor"]) < whole and (most is None or done < most):
        rows = _classed(lines.where(F.col("line").between(at + 1, at + batch)))
        before = staged(spark, folder).where("state = 'staged'").select("external_id").withColumn("known", F.lit(True))
        turn = F.row_number().over(Window.partitionBy("external_id").orderBy("line"))
        books = rows.where("payload is not null").withColumn("turn", turn).join(before, "external_id", "left")
        state = F.when((F.col("turn") == 1) & F.col("known").isNull(), "staged").otherwise("ignored")
        books = books.select("line", "external_id", "title", F.when(state == "staged", F.col("payload")).alias("payload"), state.alias("state"))
        out = books.unionByName(rows.where("payload is null").withColumn("state", F.lit("skipped")))
        out.write.mode("overwrite").parquet(f"{folder}/batch-{at:015d}")
        done += 1
    return progress(staged(spark, folder))
