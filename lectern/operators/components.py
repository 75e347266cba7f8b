"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import cut


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge table, equal for equal tables."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, root): every node of an edge and the smallest node that it reaches.

    Large-star and small-star rounds (Kiveris et al., 2014): each round links the neighbours of a node to the smallest
    of them, so a component ends as a star around its smallest node after O(log^2 n) rounds. Minima are aggregated before
    they meet the edges, so a hub's edges are never gathered in one group. Null ends and loops are ignored; an empty edge
    table gives an empty result.
    """
    e = cut(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
            .where("u <> v").where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = cut(small)
        if (new := _mark(e)) == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
