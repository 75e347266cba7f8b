"""Entity resolution: candidate pairs inside blocks, the best candidates, works and owners of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.relations import pools


def blocked_pairs(rows: DataFrame, key: str, block: Column, text: str, score, least: float = 0.0, sizes: tuple[int, int] = (2, 20)) -> DataFrame:
    """(a, b, score): pairs a < b of rows of one block with ``score(text, text)`` of ``least`` or more.

    A block with more than ``sizes[1]`` rows is no evidence (a placeholder, a series title) and has no pairs, so a row has
    a bounded number of partners. Block sizes are aggregated before rows meet. Null blocks have no pairs.
    """
    named = rows.select(F.col(key).alias("id"), F.col(text).alias("t"), block.alias("block")).where("block is not null")
    fit = named.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(*sizes)).select("block")
    kept = named.join(fit, "block", "left_semi")
    left, right = (kept.select("block", F.col("id").alias(s), F.col("t").alias(f"t_{s}")) for s in "ab")
    return left.join(right, "block").where("a < b").select("a", "b", score(F.col("t_a"), F.col("t_b")).alias("score")).where(F.col("score") >= least)


def large_blocks(rows: DataFrame, key: str, block: Column, most: int = 20) -> DataFrame:
    """(id, class_id, members): every row of a block with more than ``most`` rows, which ``blocked_pairs`` leaves out: the
    block's smallest id stands for its class. A row for each member, not for each pair. Null blocks have none."""
    named = rows.select(F.col(key).alias("id"), block.alias("block")).where("block is not null")
    large = named.groupBy("block").agg(F.min("id").alias("class_id"), F.count("*").alias("members")).where(F.col("members") > most)
    return named.join(large, "block").select("id", "class_id", "members")


def best_candidates(left: DataFrame, right: DataFrame, key: str, block: str, text: str, score, least: float, k: int, pool: int = 100) -> DataFrame:
    """(id, candidate, score, rank): for each left row the k best of the first ``pool`` right rows of its block, by id, ties to
    the smaller candidate. A block's pool is cut before anything is scored, so a row meets a bounded number of others."""
    a = left.select(F.col(key).alias("id"), F.col(block).alias("block"), F.col(text).alias("t_a"))
    b = pools(right.select(F.col(key).alias("candidate"), F.col(block).alias("block"), F.col(text).alias("t_b")), "block", "candidate", pool)
    scored = a.join(b, "block").select("id", "candidate", score(F.col("t_a"), F.col("t_b")).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def works(records: DataFrame, key: str, names: list[Column]) -> DataFrame:
    """(work_id, editions): records with the same names are editions of one work, named after its smallest record.

    Rerun over the same or more records, a work keeps its id unless a smaller record joins it."""
    return records.groupBy(*names).agg(F.min(key).alias("work_id"), F.count("*").alias("editions")).select("work_id", "editions")


def first_owner(records: DataFrame, identifier: str, key: str) -> DataFrame:
    """(identifier, owner_id, claims): an identifier belongs to the first record that gives it."""
    return records.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.min(key).alias("owner_id"), F.count("*").alias("claims"))


def volume_relation(a: Column, b: Column) -> Column:
    """match, mismatch, or missing where only one has a volume; null where none has."""
    return F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), "missing").when(a == b, "match").otherwise("mismatch")
