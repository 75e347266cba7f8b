"""Near-duplicates by similarity: one document of each group of texts that word shingles link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import only_rows
from lectern.llm.ngram_join import grouped
from lectern.storage import cut

#: Words of a shingle, and the Jaccard similarity of two texts' sets of shingles from which on they are near.
WIDTH, LEAST = 5, (4, 5)


def keep_first(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """One document of each group of texts that are equal or linked by a Jaccard similarity of 0.8 or more over five-word
    shingles, with all columns: that with the smallest doc_id (null last), of several texts under it that with the
    smallest hash. Texts without words are one group; rows that repeat doc_id and text stay one row.

    Links are those of the n-gram join, so every pair at 0.8 or more is in one group, and none is compared with all others
    that it reaches. A doc_id that stands for texts of several groups is kept once for each; columns of any name are kept; an
    empty table gives an empty result.

    ``among`` (doc_id, text_hash) names the rows of ``docs`` that an earlier step left, as ``simhash.first_rows`` does; only these
    are linked and kept. So two steps deal whole texts once, at the end.
    """
    rows, linked = grouped(docs, WIDTH, LEAST, among=among)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = rows.groupBy("key").agg(F.min(first).alias("first")).join(linked, "key", "left")
    group = F.coalesce(F.col("root").cast("string"), F.hex("key"))  # sets that nothing is linked with stand for themselves
    kept = cut(best.groupBy(group.alias("group")).agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash"))
    return only_rows(docs, kept)
