"""Reference fixtures of evaluations: page XML, JSON lines and JSON, found by one scan."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.sources.ocr import page_xml_lines

#: The forms of a fixture by the end of its name, and what is read where a record does not say.
FORMS, SPLIT, LICENSE = ("xml", "jsonl", "json"), "test", "unknown"
RECORDS = "struct<license string, overlap_note string, records array<variant>>"


@pandas_udf(T.ArrayType(T.StringType()))
def _lines(content: pd.Series) -> pd.Series:
    """The lines of page XML files; null for what is none."""

    def read(data):
        try:
            return None if data is None else page_xml_lines(bytes(data))
        except ET.ParseError:
            return None

    return pd.Series([read(c) for c in content], dtype=object)


def _must(value: Column, what: Column, problem: str) -> Column:
    return F.when(F.coalesce(value != "", F.lit(False)), value).otherwise(F.raise_error(F.concat(what, F.lit(f": {problem}"))).cast("string"))


def reference_fixtures(spark: SparkSession, path: str, dataset: str, version: str) -> DataFrame:
    """(ref_id, split, text, source, license, payload, path): the references of fixtures below ``path``, a file or a folder.

    Forms are told by the files' names: page XML gives a reference for each line, named ``dataset:stem:L0000``; JSON lines give
    one each, JSON one for each entry of a list, or of ``records`` beside a common ``license`` and ``overlap_note``. Ids
    (``ref_id`` or ``id``), splits and texts (``text`` or ``reference``) stay as they are, the record itself is kept as a
    variant, and ``source`` says dataset, overlap note and version as JSON with sorted names.

    What would lose a reference is an error when it is read: a record without id, split or text, an object without a list
    of records, a file that is no XML or JSON. Other files, blank lines and empty page lines are passed over. A file is
    read by one task.
    """
    if not dataset or not version:
        raise ValueError("a fixture needs a dataset and a version")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    form = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    files = found.select("path", form.alias("form"), "content").where(F.col("form").isin(*FORMS))
    name = F.concat(F.lit("fixture "), "path")

    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    pages = files.where("form = 'xml'").select("path", stem.alias("stem"), _lines("content").alias("lines"))
    pages = pages.select("path", "stem", F.posexplode(F.when(F.col("lines").isNull(), F.raise_error(F.concat(name, F.lit(": no XML"))).cast("array<string>")).otherwise(F.col("lines"))).alias("k", "text"))
    ident = F.concat(F.lit(f"{dataset}:"), "stem", F.lit(":L"), F.lpad(F.col("k").cast("string"), 4, "0"))
    lines = pages.where(F.trim("text") != "").select("path", ident.alias("ref_id"), F.lit(SPLIT).alias("split"), "text", F.lit("").alias("note"), F.lit(LICENSE).alias("license"), F.lit(None).cast("variant").alias("payload"))

    said = files.where("form <> 'xml'").select("path", "form", F.decode("content", "UTF-8").alias("said"))
    by_line = said.where("form = 'jsonl'").select("path", F.explode(F.split("said", "\n")).alias("said")).where("trim(said) <> ''").select("path", F.parse_json("said").alias("payload"), F.lit(LICENSE).alias("top"), F.lit("").alias("top_note"))
    whole = said.where("form = 'json'")
    object_ = F.from_json("said", RECORDS)
    listed = F.when(F.startswith(F.trim("said"), F.lit("[")), F.from_json("said", "array<variant>")).otherwise(object_["records"])
    sure = F.when(listed.isNull(), F.raise_error(F.concat(name, F.lit(": neither a list nor an object with records"))).cast("array<variant>")).otherwise(listed)
    by_entry = whole.select("path", F.explode(sure).alias("payload"), F.coalesce(object_["license"], F.lit(LICENSE)).alias("top"), F.coalesce(object_["overlap_note"], F.lit("")).alias("top_note"))
    field = lambda n: F.try_variant_get("payload", f"$.{n}", "string")
    text = F.coalesce(field("text"), field("reference"))
    records = by_line.unionByName(by_entry).select(
        "path", _must(F.coalesce(field("ref_id"), field("id")), name, "a record without id").alias("ref_id"), _must(field("split"), name, "a record without split").alias("split"), _must(text, name, "a record without text").alias("text"),
        F.coalesce(field("overlap_note"), "top_note").alias("note"), F.coalesce(field("license"), "top").alias("license"), "payload")
    source = F.to_json(F.struct(F.lit(dataset).alias("dataset"), F.col("note").alias("overlap_note"), F.lit(version).alias("version")))
    return lines.unionByName(records).select("ref_id", "split", "text", source.alias("source"), F.when(F.col("license") == "", LICENSE).otherwise(F.col("license")).alias("license"), "payload", "path")
