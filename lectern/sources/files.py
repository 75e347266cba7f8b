"""Files as rows: scans, ingest by content, caches by content and version, checked bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = (".pdf", ".epub", ".pcex")


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, supported): every file below a folder; unsupported ones are told, not dropped. Only names and
    sizes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), ends.isin(*SUPPORTED).alias("supported"))


def contents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256, size) of every file below a folder, hashed where it is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def ingest(known: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, locations): ``known`` (sha256, size) with a row for each new content of ``found`` (path, sha256, size), and
    every path with its content. Copies are one document."""
    fresh = found.groupBy("sha256").agg(F.min("size").alias("size")).join(known, "sha256", "left_anti").select(*known.columns)
    return known.unionByName(fresh), found.select("path", "sha256")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): the distinct lines of a list of files, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')").distinct()


def cached(found: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows of ``found`` (sha256, ..) with what the cache (sha256, version, ..) has for their content under
    this version, and the rows that must be computed."""
    current = cache.where(F.col("version") == version).drop("version").dropDuplicates(["sha256"])
    return found.join(current, "sha256"), found.join(current, "sha256", "left_anti")


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state) of a bundle's files (name, sha256) against its manifest: ok, changed, missing or unlisted."""
    joined = manifest.select("name", F.col("sha256").alias("_said")).join(found.select("name", F.col("sha256").alias("_is")), "name", "full")
    return joined.select("name", F.when(F.col("_said").isNull(), "unlisted").when(F.col("_is").isNull(), "missing").when(F.col("_said") == F.col("_is"), "ok").otherwise("changed").alias("state"))


def bundle(rows: DataFrame, name: str, body: str, approved: str, gold: list[str]) -> DataFrame:
    """(name, body, sha256): the approved rows of a release, with a checksum each; names that hold gold are refused."""
    leak = F.lower(name).rlike("|".join(gold)) if gold else F.lit(False)
    safe = F.when(leak, F.raise_error(F.concat(F.lit("gold in a release: "), F.col(name))).cast("string")).otherwise(F.col(body))
    return rows.where(approved).select(F.col(name).alias("name"), safe.alias("body")).withColumn("sha256", F.sha2("body", 256))
