"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import class_key, word_count
from lectern.storage import broadcast_within, cut

#: Bits of the hash that one histogram refines, and the bits of the hash.
STEP, BITS = 9, 63
#: A size that no document has.
NO_CAP = 1 << 62


def place(key: str = "doc_id", text: str = "text") -> Column:
    """A document's place in [0, 2^63): a hash of its key and text, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(cls, source_size, target, whole, need) for each source of (cls, size).

    Sources in the order of their keys weigh ``weights``, repeating, and share ``share`` of all sizes. A target stops at
    ``cap`` times the source's size; what it leaves is shared again by weight among the others. Sorted by the ratio of
    cap and weight, a source is capped exactly if its share of what the earlier ones leave reaches its cap, so one sorted
    pass over one row per source finds all of them. ``whole`` is how often all of the source is taken, ``need`` what is
    still to take.
    """
    totals = sizes.groupBy("cls").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("cls")) - 1) % len(weights)
    rows = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("most", F.col("source_size") * float(cap))
    every = Window.partitionBy()
    past = Window.orderBy(F.col("most") / F.col("w"), "cls").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("most").over(past), F.lit(0.0)))
                           / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(past), F.lit(0.0))))
    rows = rows.withColumn("capped", F.col("level") * F.col("w") >= F.col("most"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("most") / F.col("w")).alias("r"), "cls", "level"))).over(every)["level"]
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("w")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.when(F.col("capped"), F.lit(float(cap))).otherwise(F.try_divide("target", "source_size")))).otherwise(0)
    return rows.withColumn("whole", whole.cast("int")).select("cls", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))


def threshold(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(cls, lo, hi, cap, left): for each (cls, need, lo, cap), the place ``hi`` up to which rows fit into ``need``.

    Only rows at ``lo`` or above with size at most ``cap`` count. A histogram of sizes by hash bucket finds the bucket in
    which the running sum passes the need; the next histogram covers that bucket alone, with the next bits of the hash,
    until it holds one row or the hash ends. No row is sorted.
    """
    start = state.select("cls", "need", "lo", "cap", F.lit(0).cast("long").alias("prefix"), F.lit(BITS).alias("shift"), F.lit(2).cast("long").alias("n"))
    at, shift = cut(start), BITS
    while shift and not at.where("n > 1").isEmpty():
        shift -= STEP
        inside = (rows.join(broadcast_within(at.where("n > 1")), "cls")
                  .where((F.col("u") >= F.col("lo")) & (F.col("size") <= F.col("cap")) & (F.shiftright("u", shift + STEP) == F.col("prefix"))))
        hist = inside.groupBy("cls", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.count("*").alias("rows"))
        upto = F.sum("s").over(Window.partitionBy("cls").orderBy("bucket"))
        past = hist.withColumn("upto", upto).join(broadcast_within(at.select("cls", "need")), "cls").where("upto > need")
        edge = cut(past.groupBy("cls").agg(F.min("bucket").alias("bucket"), F.min("upto").alias("upto"), F.min_by("s", "bucket").alias("s"), F.min_by("rows", "bucket").alias("rows")))
        was_open, found = F.col("n") > 1, F.col("bucket").isNotNull()
        new = lambda hit, miss, old: F.when(was_open & found, hit).when(was_open, miss).otherwise(old)
        at = cut(at.join(broadcast_within(edge), "cls", "left").select(
            "cls", "lo", "cap",
            new(F.col("need") - F.col("upto") + F.col("s"), F.col("need"), F.col("need")).alias("need"),
            new(F.col("bucket"), F.lit(None), F.col("prefix")).cast("long").alias("prefix"),  # null: all rows fit
            new(F.lit(shift), F.lit(0), F.col("shift")).cast("int").alias("shift"),
            new(F.col("rows"), F.lit(0), F.col("n")).cast("long").alias("n"),
        ))
    hi = F.coalesce(F.expr("shiftleft(prefix, shift)"), F.lit((1 << 63) - 1))
    return cut(at.select("cls", "lo", hi.cast("long").alias("hi"), "cap", F.col("need").alias("left")))


def mix_plan(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, passes: int = 3) -> DataFrame:
    """(cls, source_size, target, whole, bands) for each source of (cls, u, size).

    A document is taken ``whole`` times, and once more if it lies in a band (lo, hi, cap): lo <= u < hi and size <= cap.
    The first band is the source's threshold. What it leaves open because the next document is too large is filled from
    the documents behind it that are small enough, ``passes`` times in all.
    """
    plan = cut(targets(sizes, weights, share, cap))
    state = plan.where("need >= 1").select("cls", "need", F.lit(0).cast("long").alias("lo"), F.lit(NO_CAP).cast("long").alias("cap"))
    bands = []
    for _ in range(passes):
        state = cut(state)
        if state.isEmpty():
            break
        band = threshold(sizes, state)
        bands.append(band.select("cls", F.struct("lo", "hi", "cap").alias("band")))
        state = band.where("left >= 1").select("cls", F.col("left").alias("need"), F.col("hi").alias("lo"), F.floor("left").cast("long").alias("cap"))
    none = "array<struct<lo:bigint,hi:bigint,cap:bigint>>"
    if not bands:
        return plan.select("cls", "source_size", "target", "whole", F.array().cast(none).alias("bands"))
    found = bands[0]
    for b in bands[1:]:
        found = found.union(b)
    found = cut(found.groupBy("cls").agg(F.array_sort(F.collect_list("band")).alias("bands")))  # at most ``passes`` a source
    return cut(plan.join(found, "cls", "left").select("cls", "source_size", "target", "whole", F.coalesce("bands", F.array().cast(none)).alias("bands")))


def repeats(u: Column, size: Column) -> Column:
    """How often a document is taken, by the columns of a plan. ``size`` is only looked at where a band asks for it."""
    inside = F.exists("bands", lambda b: (u >= b["lo"]) & (u < b["hi"]) & ((b["cap"] >= NO_CAP) | (size <= b["cap"])))
    return F.col("whole") + F.when(inside, 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, passes: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document of (doc_id, text, source).

    ``size`` counts the words of the text, ``taken`` is the size times how often the mix takes the document. A null text
    has size 0, a null source is a source of its own and the last. Rows equal in doc_id and text share a place and are
    taken alike. An empty table gives an empty result; other columns are ignored.
    """
    sizes = cut(docs.select("doc_id", class_key("source").alias("cls"), place().alias("u"), word_count().alias("size")))
    plan = mix_plan(sizes, weights, share, cap, passes)
    return (sizes.join(broadcast_within(plan), "cls")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * repeats(F.col("u"), F.col("size"))).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, passes: int = 3) -> DataFrame:
    """The documents of the mix with all their columns, each as many rows as it is taken.

    Null and empty texts have no words, so all of them are taken as often as their source is whole; columns of any name are
    kept; an empty table stays empty. Words are counted once; the texts are read again for the rows that are taken.
    """
    names = docs.columns
    full = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), class_key("source").alias("cls"), place().alias("u"), docs["text"].alias("said"))
    plan = mix_plan(cut(full.select("cls", "u", word_count("said").alias("size"))), weights, share, cap, passes)
    taken = full.join(broadcast_within(plan), "cls").withColumn("times", repeats(F.col("u"), word_count("said")))
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("row.*")
