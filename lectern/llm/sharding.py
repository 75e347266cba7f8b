"""Jump consistent hashing onto shards (Lamping and Veach, 2014), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import cut

#: The multiplier of the published generator, as 16-bit limbs from the lowest.
MULTIPLIER = 2862933555777941757
LIMBS = [MULTIPLIER >> 16 * i & 0xFFFF for i in range(4)]


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of key * MULTIPLIER + 1 mod 2^64, for a key in two 32-bit halves.

    Spark's long product raises on overflow, so the product is put together from partial products under 2^48.
    """
    a0, a1, a2, a3 = LIMBS
    mask, low16 = F.lit((1 << 32) - 1), F.lit(0xFFFF)
    over = lo * a1
    low = lo * a0 + F.shiftleft(over.bitwiseAND(low16), 16) + 1
    high = (F.shiftright(low, 32) + F.shiftright(over, 16) + lo * a2 + F.shiftleft((lo * a3).bitwiseAND(low16), 16)
            + hi * a0 + F.shiftleft((hi * a1).bitwiseAND(low16), 16))
    return high.bitwiseAND(mask), low.bitwiseAND(mask)


def jumps(key: Column, most: int) -> Column:
    """Array of the jumps of a 64-bit key under ``most`` shards, ascending from 0.

    The shard for n <= most shards is the last jump under n: growing n only ever adds the jump n - 1, so rows move to a
    new shard alone.
    """
    mask = F.lit((1 << 32) - 1)
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(mask).alias("lo"), F.lit(0).cast("long").alias("at"), F.array(F.lit(0).cast("long")).alias("path"))

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        at = F.floor((s["at"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        path = F.when(at < most, F.array_append(s["path"], at)).otherwise(s["path"])
        return F.when(s["at"] >= most, s).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), at.alias("at"), path.alias("path")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most - 1))), start, jump)["path"]


def jump_shard(key: Column, shards: int) -> Column:
    """Shard in 0 .. shards - 1 of a long key, by the published function."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    return F.array_max(jumps(key, shards)).cast("int")


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (key, size, text_crc32, shard, slot, grown_shard) for each document.

    The hashed key and the shard count alone decide the shard; ``grown_shard`` is the one under ``shards + 1``. ``size`` is
    the text's UTF-8 bytes plus 8, ``text_crc32`` its unsigned CRC-32. ``slot`` numbers a shard's rows from 0 without gaps:
    rows are numbered inside (shard, input partition), and partitions are offset by a running sum of their counts, so no
    group outgrows an input partition however often one key or text repeats. The numbering is written once before it is
    used, so a lost executor cannot change it.

    Null text counts as empty; a null key hashes like any other value; repeated rows share a shard and get slots of their
    own; an empty table gives an empty result; columns besides key and text are ignored.
    """
    body, path = F.coalesce(F.col(text), F.lit("")), jumps(F.xxhash64(F.col(key)), shards + 1)
    rows = cut(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.spark_partition_id().alias("part"), path.alias("path"),
    ).select("doc_id", "size", "text_crc32", "part", F.array_max(F.filter("path", lambda j: j < shards)).cast("int").alias("shard"), F.array_max("path").cast("int").alias("grown_shard")))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("nth", F.row_number().over(inside) - 1).join(first, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard"))
