"""Review of edits: gates, overlaps, splicing, conflicts, order errors, reconciliation."""

from __future__ import annotations

from bisect import bisect_right, insort
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def classify_edit(reference: Column, before: Column, after: Column) -> Column:
    """beneficial, harmful or neutral by the change of the distance to the reference."""
    old, new = F.levenshtein(before, reference), F.levenshtein(after, reference)
    return F.when(new < old, "beneficial").when(new > old, "harmful").when(new == old, "neutral")


def gate(size: Column, confidence: Column, agreement: Column, most: int = 2, below: float = 70.0) -> Column:
    """accept small edits where the engine was unsure and others agree, abstain where a signal is missing, else reject."""
    missing = size.isNull() | confidence.isNull() | agreement.isNull()
    return F.when(missing, "abstain").when((size <= most) & (confidence < below) & agreement, "accept").otherwise("reject")


# --- Gates: each gives (gate, decision) of an edit, the decision being pass, reject, or abstain where it cannot tell


def _gate(name: str, passes: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), F.when(passes.isNull(), "abstain").when(passes, "pass").otherwise("reject").alias("decision"))


def unchanged(before: str, after: str) -> Column:
    """Rejects an edit that changes nothing."""
    return _gate("unchanged", F.col(before) != F.col(after))


def edit_size(before: str, after: str, most: int = 2) -> Column:
    """Rejects edits of more than ``most`` characters."""
    return _gate("edit_size", F.levenshtein(before, after) <= most)


def confidence_below(confidence: str, below: float = 70.0) -> Column:
    """Rejects edits where the engine was sure of what it read."""
    return _gate("confidence", F.col(confidence) < below)


def agreement(agreed: str) -> Column:
    """Rejects edits that no other reading bears out."""
    return _gate("agreement", F.col(agreed))


def probability_from(probability: Column, threshold: float) -> Column:
    """Passes edits from a calibrated probability on; below it nothing is told."""
    return _gate("probability", F.when(probability >= threshold, True))


def decided(edits: DataFrame, gates: list[Column]) -> DataFrame:
    """``edits`` with ``decision`` and ``gate``: accept if all gates pass; else the first that does not says reject or abstain,
    and ``gate`` names it."""
    stopped = F.filter(F.array(*gates), lambda g: g["decision"] != "pass")
    first = F.try_element_at(stopped, F.lit(1))
    return edits.withColumn("_first", first).withColumns({"decision": F.coalesce(F.col("_first.decision"), F.lit("accept")), "gate": F.col("_first.gate")}).drop("_first")


def without_overlaps(spans: DataFrame, page: str, start: str = "start", end: str = "end", key: str = "id") -> DataFrame:
    """The spans that a pass in the order (start, end, key) keeps: each that starts at or behind the end of the last kept one.

    Spans are first cut into islands, across whose borders nothing overlaps; each island is folded on its own, so what is
    gathered is only as long as spans that chain into each other."""
    order = Window.partitionBy(page).orderBy(start, end, key)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(page, start, end, key).withColumn("_new", F.coalesce((F.col(start) >= reach).cast("int"), F.lit(1)))
    islands = marked.withColumn("_island", F.sum("_new").over(order)).groupBy(page, "_island").agg(
        F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(key).alias("k")))).alias("all"))
    kind = islands.schema["all"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    kept = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.coalesce(none, F.slice("all", 1, 1)),
                       lambda got, x: F.when(x["s"] >= F.element_at(got, -1)["e"], F.array_append(got, x)).otherwise(got))
    return islands.select(page, F.explode(kept).alias("x")).select(page, F.col("x.s").alias(start), F.col("x.e").alias(end), F.col("x.k").alias(key))


def spliced(text: Column, edits: Column) -> Column:
    """``text`` with the edits (start, end, before, after) put in from the right; an edit whose ``before`` is not there
    raises an error. Positions count characters from 0; edits must not overlap."""
    right_first = F.reverse(F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["before"].alias("before"), e["after"].alias("after")))))

    def put(got: Column, e: Column) -> Column:
        there = F.substring(got, e["start"] + 1, e["end"] - e["start"])
        new = F.concat(F.substring(got, F.lit(1), e["start"]), e["after"], F.substring(got, e["end"] + 1, F.char_length(got)))
        return F.when(there == e["before"], new).otherwise(F.raise_error(F.lit("an edit does not match its text")).cast("string"))

    return F.aggregate(right_first, text, put)


def merged(votes: DataFrame, page: str, text: str) -> DataFrame:
    """(page, votes, status, text): the text if all non-null votes agree, else an open conflict without one."""
    said = votes.groupBy(page).agg(F.count(text).alias("votes"), F.min(text).alias("lo"), F.max(text).alias("hi"))
    agreed = F.col("lo") == F.col("hi")
    return said.select(page, "votes", F.when(agreed, "agreed").when(F.col("votes") == 0, "no_output").otherwise("conflict").alias("status"), F.when(agreed, F.col("lo")).alias("text"))


@pandas_udf(T.LongType())
def inversions(order: pd.Series, place: pd.Series) -> int:
    """Pairs of a page's items that come in the wrong order; for use in ``groupBy(page).agg``. Nulls are left out."""
    seen, wrong = [], 0
    for _, p in sorted((o, p) for o, p in zip(order, place) if not (pd.isna(o) or pd.isna(p))):
        wrong += len(seen) - bisect_right(seen, p)
        insort(seen, p)
    return wrong


def reconcile(spark, checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check, expected, found, ok) for pairs of tables with one number each."""
    one = lambda n, s: F.col(s.columns[0]).cast("long").alias(n)
    rows = [e.select(one("expected", e)).crossJoin(f.select(one("found", f))).select(F.lit(name).alias("check"), "expected", "found") for name, (e, f) in checks.items()]  # one row each
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("expected").eqNullSafe(F.col("found")))


def repeated_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """(line, docs): lines that stand in ``least`` documents or more. A document counts once for a line."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.distinct().groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def token_spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, k, token, start, stop): the words of each text between white space, with their characters."""
    pieces = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))).alias("k", "piece"))
    stop = F.sum(F.char_length("piece")).over(Window.partitionBy(key).orderBy("k"))
    token = F.regexp_replace("piece", r"^\s+", "")
    return pieces.select(key, (F.col("k") + 1).cast("long").alias("k"), token.alias("token"), stop.alias("stop")).withColumn("start", F.col("stop") - F.char_length("token"))
