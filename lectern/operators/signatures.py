"""Bit signatures and the pairs within a Hamming radius."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_bits(vector: str, bits: int = 62) -> Column:
    """Bit i is set where component i is positive, for the first ``bits`` components, 64 at most; bit 63 is the sign."""
    each = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


#: Near keys of a band that are looked up at most; more bands make them fewer.
NEAR_KEYS = 1000


def near_masks(radius: int, bits: int) -> tuple[list[int], int, list[int]]:
    """(edges of the bands, bits that the nearest band differs in at most, masks of so many bits or fewer).

    Bands have 16 bits or fewer. Two signatures within the radius differ in radius // bands bits or fewer in one of them, so
    the keys of a band near a row's own, its key under each mask, hold all that are near by this band.
    """
    bands = -(-bits // 16)
    while sum(comb(-(-bits // bands), k) for k in range(radius // bands + 1)) > NEAR_KEYS:
        bands += 1
    wide, within = -(-bits // bands), radius // bands
    masks = [sum(1 << i for i in chosen) for k in range(within + 1) for chosen in combinations(range(wide), k)]
    return [bits * i // bands for i in range(bands + 1)], within, masks


def hamming_candidates(classes: DataFrame, radius: int, bits: int) -> DataFrame:
    """(band, id_a, sig_a, id_b, sig_b): the rows of ``classes`` (id, sig) that meet by multi-index hashing, copies included: every
    row is looked up under the near keys of each of its bands. A row meets a share of masks / 2 ** 16 of the others in
    each band of random bits, 0.8 % in all for radius 10 of 64, where bands of equal keys alone would have to be 5 or 6 bits
    narrow and bring it to a quarter."""
    edge, _, masks = near_masks(radius, bits)
    keys = F.array(*[F.shiftright("sig", lo).bitwiseAND((1 << hi - lo) - 1).cast("int") for lo, hi in zip(edge, edge[1:])])
    dealt = classes.select("id", "sig", F.posexplode(keys).alias("band", "key"))
    asked = dealt.select("band", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("key").bitwiseXOR(m))).alias("key"), F.col("id").alias("id_a"), F.col("sig").alias("sig_a"))
    return asked.join(dealt.select("band", "key", F.col("id").alias("id_b"), F.col("sig").alias("sig_b")), ["band", "key"])


def hamming_pairs(rows: DataFrame, key: str, signature: Column, radius: int = 10, bits: int = 62) -> DataFrame:
    """(a, b, distance): pairs of different signatures within ``radius`` bits, each by the smallest key that has it.

    Equal signatures are one class, so copies are never paired with each other. A pair is taken from the first band in which
    it is near.
    """
    classes = rows.select(F.col(key).alias("id"), signature.alias("sig")).where("sig is not null").groupBy("sig").agg(F.min("id").alias("id"))
    edge, within, _ = near_masks(radius, bits)
    other = F.col("sig_a").bitwiseXOR(F.col("sig_b"))
    first = F.lit(None).cast("int")
    for band, (lo, hi) in reversed(list(enumerate(zip(edge, edge[1:])))):
        first = F.when(F.bit_count(F.shiftright(other, lo).bitwiseAND((1 << hi - lo) - 1)) <= within, band).otherwise(first)
    met = hamming_candidates(classes, radius, bits).where((F.col("id_a") < F.col("id_b")) & (F.bit_count(other) <= radius) & (first == F.col("band")))
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.bit_count(other).alias("distance"))


def hamming_members(rows: DataFrame, key: str, signature: Column, radius: int = 10, bits: int = 64) -> DataFrame:
    """(id, class_id, members, links): every row with a signature. The smallest id with its signature stands for its class
    of ``members`` rows; ``links`` counts the other classes within ``radius`` bits, those that ``hamming_pairs`` pairs it with."""
    signed = rows.select(F.col(key).alias("id"), signature.alias("sig")).where("sig is not null")
    classes = signed.groupBy("sig").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    pairs = hamming_pairs(rows, key, signature, radius, bits)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    known = classes.join(ends, "class_id", "left").na.fill(0, ["links"])
    return signed.join(known, "sig").select("id", "class_id", "members", "links")
