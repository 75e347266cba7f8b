"""Catalogue queries: statistics, search, paging, existence, ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """Rows by source."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def contains(column: Column, words: str) -> Column:
    """Case-insensitive containment in which % and _ stay wildcards."""
    return column.ilike(f"%{words}%")


def lookup(rows: DataFrame, **given) -> DataFrame:
    """Rows that equal every given value; a value of None asks for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [x for x in given.items() if x[1] is not None], rows)


def entities(kinds: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(kind, id, title) of several tables: for each kind its table, id and title columns."""
    return reduce(DataFrame.unionByName, (t.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(title).alias("title")) for kind, (t, key, title) in kinds.items()))


def page_after(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next page in the order of ``keys``: the rows behind the tuple ``after``."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after)]))
    return rows.orderBy(*keys).limit(size)


def with_missing(rows: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """``rows`` with a row of nulls for each kind that has none."""
    return kinds.join(rows, key, "left")


def bm25(docs: DataFrame, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents that hold any of the words, by BM25.

    One pass counts the query's words in each document; document frequencies and the mean length are two small
    aggregates, so no inverted index is spread over the cluster for a query.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    counted = docs.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("len"), *[count(w).alias(f"tf_{w}") for w in words])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf_{w}") > 0).cast("long")).alias(f"df_{w}") for w in words])
    score = sum((F.log(1 + (F.col("n") - F.col(f"df_{w}") + 0.5) / (F.col(f"df_{w}") + 0.5)) * F.col(f"tf_{w}") * (k1 + 1) / (F.col(f"tf_{w}") + k1 * (1 - b + b * F.col("len") / F.col("mean"))) for w in words), F.lit(0.0))
    held = reduce(Column.__or__, (F.col(f"tf_{w}") > 0 for w in words))
    return counted.where(held).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score"))  # one row of statistics
