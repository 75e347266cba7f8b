"""Duplicates of documents: keepers, edges, clusters, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.components import connected_components


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keeper_id, group_size) of texts with copies; the keeper is the longest, ties by id."""
    marked = docs.select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"))
    groups = marked.groupBy("sha").agg(F.count("*").alias("group_size"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("keeper_id")).where("group_size > 1")
    return marked.join(groups, "sha").select("doc_id", "keeper_id", "group_size")


def copy_edges(docs: DataFrame, by: str = "lang") -> DataFrame:
    """(a, b, relation): each copy linked to the first of its group; a copy with another ``by`` is a format variant."""
    marked = docs.select("doc_id", by, F.sha2("text", 256).alias("sha"))
    first = marked.groupBy("sha").agg(F.min("doc_id").alias("a"), F.min_by(by, "doc_id").alias("kind"), F.count("*").alias("n")).where("n > 1")
    return marked.join(first, "sha").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.when(F.col(by).eqNullSafe(F.col("kind")), "duplicate").otherwise("format_variant").alias("relation"))


def clusters(edges: DataFrame, review_over: int = 8) -> DataFrame:
    """(doc_id, cluster_id, size, review): connected components; large ones are marked for review."""
    members = connected_components(edges)
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    return members.join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster_id"), "size", (F.col("size") > review_over).alias("review"))


def safe_removals(members: DataFrame, edges: DataFrame, keepers: DataFrame) -> DataFrame:
    """Members that are linked to their cluster's keeper (cluster_id, keeper_id) themselves, and so may go."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return members.join(keepers, "cluster_id").where("doc_id <> keeper_id").join(both, (F.col("doc_id") == F.col("a")) & (F.col("keeper_id") == F.col("b")), "left_semi").select("doc_id", "keeper_id")


def near_lengths(docs: DataFrame, share: float = 0.02) -> DataFrame:
    """(doc_id, links): how many other documents of its source have a size that differs by at most ``share`` of the smaller
    one, 1 at least.

    Documents are first counted by source and size, so only different sizes meet: in a range join over buckets as wide as
    the widest range that starts there, so that a pair meets in the bucket of the smaller or the next one.
    """
    docs = docs.where("n_chars > 0").select("doc_id", "source", "n_chars")
    sized = docs.groupBy("source", "n_chars").agg(F.count("*").alias("n")).withColumn("most", F.greatest(F.lit(1), F.floor(F.col("n_chars") * share)))
    width = F.floor(F.log(1 + 2 * share, F.col("n_chars").cast("double") + 1 / share))
    left = sized.select("source", F.col("n_chars").alias("x"), F.col("n").alias("nx"), "most", F.explode(F.array(width, width + 1)).alias("cell"))
    right = sized.select("source", F.col("n_chars").alias("y"), F.col("n").alias("ny"), width.alias("cell"))
    pairs = left.join(right, ["source", "cell"]).where("y - x between 1 and most")
    either = pairs.select("source", F.explode(F.array(F.struct(F.col("x").alias("n_chars"), F.col("ny").alias("links")), F.struct(F.col("y").alias("n_chars"), F.col("nx").alias("links")))).alias("e"))
    links = either.groupBy("source", F.col("e.n_chars").alias("n_chars")).agg(F.sum("e.links").alias("other"))
    counted = sized.join(links, ["source", "n_chars"], "left").select("source", "n_chars", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    return docs.join(counted, ["source", "n_chars"]).select("doc_id", "links")
