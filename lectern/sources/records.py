"""Source records: line dumps in, keyed tables and line files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.lines import last_of, numbered, placed

BOOK = "url string, name string, productType string, authors array<string>, specification string, ratingValue string, ratingCount string, _bad string"


def json_lines(spark: SparkSession, path: str, schema: str = BOOK) -> DataFrame:
    """Records of a JSONL dump; a broken line has nulls and its text in ``_bad``; blank lines go."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")


def books(records: DataFrame) -> DataFrame:
    """Only books with a title."""
    return records.where((F.col("productType") == "book") & (F.trim("name") != ""))


def tab_dump(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, revision, modified, payload) of five-field lines, or JSON lines as payloads alone."""
    parts = F.split("value", "\t", 5)
    return spark.read.text(path).select(*[F.when(F.size(parts) == 5, parts[i]).alias(n) for i, n in enumerate(("kind", "key", "revision", "modified"))], F.when(F.size(parts) == 5, parts[4]).otherwise(F.col("value")).alias("payload"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows without those that new ones replace, and of each key the new row that was written last.

    ``order`` is the column of ``new`` that says so; of equals the row that is largest column by column stays, so reruns
    agree. Without it a key that new rows repeat is an error, as nothing tells which came last. Null keys equal each other.
    """
    columns = [c for c in new.columns if c != order or c in old.columns]
    last = F.struct(*[F.col(c) for c in ([order] if order else []) + [c for c in new.columns if c != order]])
    one = new.groupBy(*keys).agg(F.max(last).alias("row"), F.count("*").alias("n"))
    if order is None:
        one = one.withColumn("row", F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("a key stands in several new rows and no column orders them"))))
    fresh = one.select(*[F.col("row")[c].alias(c) for c in columns])
    gone = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return old.join(gone, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti").unionByName(fresh)


SPECIFICATION = "Title string, Author string, ISBN string, Publisher string, Edition string, `Number of Pages` string, Language string"


def retail(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """(line, title, author, isbn, pages, url, name): books of a retailer's JSONL dump behind line ``after``, with their
    specification, which is JSON inside JSON. ``line`` is the cursor to go on from; broken lines and other products go. A
    dump of any size is read in parts."""
    lines = numbered(spark, path).where((F.col("line") > after) & (F.trim("value") != ""))
    rows = lines.select("line", F.from_json("value", BOOK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("line", "r.*").where("_bad is null")
    s = F.from_json("specification", SPECIFICATION)
    title = F.coalesce(F.when(F.trim(s["Title"]) != "", s["Title"]), F.col("name")).alias("title")
    pages = F.regexp_extract(s["Number of Pages"], "[0-9]+", 0).try_cast("int").alias("pages")
    return books(rows).select("line", title, s["Author"].alias("author"), s["ISBN"].alias("isbn"), pages, "url", "name")


def legacy_books(records: DataFrame) -> DataFrame:
    """(title, author, isbn): the first author alone, and an ISBN's digits if they are ten or more."""
    digits = F.regexp_replace(F.coalesce("isbn", F.lit("")), "[^0-9]", "")
    return records.select(F.trim("name").alias("title"), F.try_element_at("authors", F.lit(1)).alias("author"), F.when(F.char_length(digits) >= 10, digits).alias("isbn")).where("title <> ''")


def dump_records(dump: DataFrame, kinds: tuple[str, ...] = ("/type/edition", "/type/work")) -> DataFrame:
    """(kind, key, title, payload) of dump lines with a title: JSON lines of any kind, five-field lines of the given kinds."""
    title = F.trim(F.get_json_object("payload", "$.title"))
    kind = F.coalesce("kind", F.get_json_object("payload", "$.type.key"))
    return dump.select(kind.alias("kind"), F.coalesce("key", F.get_json_object("payload", "$.key")).alias("key"), title.alias("title"), "payload").where((F.col("title") != "") & (F.col("kind").isNull() | F.col("kind").isin(*kinds)))


def response_items(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, id, title, payload): the items of API responses that have a title; an item without an id is named by its place."""
    items = responses.select(key, F.posexplode(F.from_json(F.get_json_object(raw, "$.items"), "array<string>")).alias("k", "payload"))
    ident = F.coalesce(F.get_json_object("payload", "$.id"), F.concat(F.lit("position:"), F.col("k").cast("string")))
    return items.select(key, ident.alias("id"), F.trim(F.get_json_object("payload", "$.volumeInfo.title")).alias("title"), "payload").where("title <> ''")


def coverage_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: all rows of a CSV with a header, and those in which each column is not blank; a column that is not there is
    null, not 0."""
    rows = spark.read.option("header", True).csv(path)
    told = [F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "").alias(c) if c in rows.columns else F.lit(None).cast("long").alias(c) for c in columns]
    return rows.agg(F.count("*").alias("rows"), *told)


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, seconds, error, model_rev): the last line of each id in JSONL files, the files being read by name and each
    from its start, however tasks share them out."""
    said = F.from_json("value", "id string, text string, seconds double, error string, model_rev string")
    lines = placed(spark, path).withColumn("said", said)
    return last_of(lines, F.col("said.id"), F.col("said")).select("value.*")
