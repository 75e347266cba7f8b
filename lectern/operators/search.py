"""Ranked search for any words: an index of posting blocks with the most that a block can add, and top-k that skips blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import word_tokens
from lectern.storage import broadcast_within, cut, delete, park, park_at

#: Ids of a range, block maxima of a term that are kept for thresholds, and the constants of BM25.
RANGE, TOPS = 128, 100
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits, in any script."""
    return word_tokens(F.lower(text))


@dataclass
class Index:
    """``blocks`` (term, range, top, postings array of (doc, impact)): what a term adds to each document of a range of ids, and the
    most of it; ``tops`` (term, df, tops): a term's largest block maxima, descending."""

    blocks: DataFrame
    tops: DataFrame

    def save(self, folder: str) -> None:
        """Writes both tables; blocks are sorted by term, so that a search reads the files of its terms."""
        self.blocks.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{folder}/blocks")
        self.tops.write.mode("overwrite").parquet(f"{folder}/tops")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/tops"))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = RANGE, only: DataFrame | None = None) -> Index:
    """The index of all texts by BM25. ``key`` is an integer, and ids that are near stand in a range; null keys and texts are left
    out, and rows that repeat a key are one document with all their words.

    Words are counted in each document, then dealt by term and range, so a common word's postings are many small groups. ``only``
    (term) names the words that will be asked for, null for all: postings of others are not made, while lengths and the number of
    documents are those of whole texts, so scores are the same. Blocks are parked (``storage.park``).
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), terms(F.col(text)).alias("t"))
    lengths = rows.groupBy("doc").agg(F.sum(F.size("t")).alias("len"))
    stats = cut(lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")))
    words = rows.select("doc", F.explode("t").alias("term"))
    if only is not None:
        words = words.join(broadcast_within(cut(only.select("term").distinct())), "term", "left_semi")
    counted = words.groupBy("doc", "term").agg(F.count("*").alias("tf")).join(lengths, "doc")
    each, path = park_at(counted.withColumn("range", F.floor(F.col("doc") / width)).groupBy("term", "range").agg(F.collect_list(F.struct("doc", "tf", "len")).alias("p"), F.count("*").alias("n_docs")))
    df = cut(each.groupBy("term").agg(F.sum("n_docs").alias("df")))
    known = each.drop("n_docs").join(broadcast_within(df), "term").join(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = lambda p: F.struct(p["doc"].alias("doc"), (idf * p["tf"] * (K1 + 1) / (p["tf"] + K1 * (1 - B + B * p["len"] / F.col("mean")))).alias("impact"))
    blocks = known.select("term", "range", "df", F.transform("p", impact).alias("postings")).withColumn("top", F.array_max(F.transform("postings", lambda p: p["impact"])))
    blocks = park(blocks.select("term", "df", "range", "top", "postings"))
    delete(docs.sparkSession, path)
    best = blocks.select("term", "df", "top").withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top")))).where(F.col("r") <= TOPS)
    tops = cut(best.groupBy("term").agg(F.first("df").alias("df"), F.sort_array(F.collect_list("top"), asc=False).alias("tops")))
    return Index(blocks.select("term", "range", "top", "postings"), tops)


def surviving(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, range): ranges in which one of the best ``k`` documents can stand, for ``asked`` (query, term).

    The k-th largest block maximum of a term is reached by k documents, so the best of these over a query's terms is under
    its k-th score. A range whose terms' maxima do not add up to it holds none of the best k.
    """
    floor = asked.join(index.tops, "term").groupBy("query").agg(F.max(F.coalesce(F.try_element_at("tops", F.lit(k)), F.lit(0.0))).alias("floor"))
    most = index.blocks.select("term", "range", "top").join(broadcast_within(asked), "term").groupBy("query", "range").agg(F.sum("top").alias("most"))
    return most.join(broadcast_within(floor), "query").where(F.col("most") >= F.col("floor") - 1e-6).select("query", "range")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query, doc, score, rank) of the ``k`` best documents by BM25 of each query, ties to the smaller id; a query's words count
    once. Exactly those that scoring every document gives: ranges are skipped only where none of them can stand. A query
    without words, or of words that stand nowhere, gives no rows; ``k`` is at most TOPS."""
    if not 0 < k <= TOPS:
        raise ValueError(f"k is 1 to {TOPS}")
    asked = cut(queries.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("query"), F.explode(terms(F.col(text))).alias("term")).distinct())
    left = cut(surviving(index, asked, k))
    wanted = asked.join(left, "query").select("query", "term", "range")
    met = index.blocks.select("term", "range", "postings").join(broadcast_within(cut(wanted)), ["term", "range"]).select("query", F.explode("postings").alias("p"))
    scored = met.groupBy("query", F.col("p.doc").alias("doc")).agg(F.round(F.sum("p.impact"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
