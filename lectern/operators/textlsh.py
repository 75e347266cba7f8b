"""Text duplicates by MinHash signatures and banding: signatures, band keys, and links between similar texts."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.functions.keys import shingle_view
from lectern.operators.components import connected_components
from lectern.storage import broadcast_within, cut, texts

#: Characters of a shingle, places of a signature (a power of two), bands, shingles that make a text usable, and the
#: similarity of a link.
SHINGLE, PLACES, BANDS, USABLE, LEAST = 9, 128, 16, 500, 0.75
#: Fixed value: the base of a shingle's polynomial, modulo 2 ** 64.
BASE = 1099511628211
#: An odd factor that spreads the polynomials.
SPREAD = 0x9E3779B97F4A7C15
#: Bits of a hash that choose its place, and bits below its value, which has 32.
PLACE_BITS = PLACES.bit_length() - 1
REST = 64 - PLACE_BITS - 32
#: The prime of the permutations, shingles that are permuted at once, and classes that a task compares with as many.
PRIME, CHUNK, BLOCK = (1 << 31) - 1, 256, 4096
SIGNED = T.StructType().add("signature", T.ArrayType(T.LongType())).add("shingles", T.LongType())


def shingle_hashes(view: str) -> np.ndarray:
    """The distinct 64-bit hashes of a normalised text's shingles, ascending: sum of code point * BASE^place, spread by a factor,
    modulo 2 ** 64."""
    codes = np.frombuffer(view.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < SHINGLE:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        total += codes[j:j + len(total)] * np.uint64(pow(BASE, j, 1 << 64))
    total *= np.uint64(SPREAD)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def minhash(spread: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of ascending hashes: a hash chooses a place by its first bits, and each place holds the least of
    the next 32 bits. An empty place borrows from the next one that is not, counted round, and adds 2 ** 32 for each place
    between, so that two texts agree there only where both borrow the same. Zeros without hashes."""
    if not len(spread):
        return np.zeros(PLACES, np.int64)
    place = (spread >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
    there, first = np.unique(place, return_index=True)
    value = (spread[first] >> np.uint64(REST)).astype(np.int64) & 0xFFFFFFFF
    after = np.searchsorted(there, np.arange(PLACES)) % len(there)
    return value[after] + ((there[after] - np.arange(PLACES)) % PLACES << 32)


def coefficients(n: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the permutations, from the first 32 bits of MD5, so that other engines can draw them."""
    draw = lambda kind: np.array([int(hashlib.md5(f"{kind}:{i}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1 for i in range(n)], np.uint64)
    return draw("a"), draw("b")


_A, _B = coefficients()


def permuted(spread: np.ndarray) -> np.ndarray:
    """MinHash by 128 permutations: the least (a * h + b) mod PRIME of each, over the polynomials h of hashes that are spread.
    Zeros without hashes. Products stay under PRIME squared, so one fold and one subtraction take the remainder."""
    if not len(spread):
        return np.zeros(PLACES, np.int64)
    prime, low = np.uint64(PRIME), np.full(PLACES, PRIME, np.uint64)
    own = spread * np.uint64(pow(SPREAD, -1, 1 << 64)) % prime
    x, y = (np.empty((min(CHUNK, len(own)), PLACES), np.uint64) for _ in range(2))
    for at in range(0, len(own), CHUNK):
        n = min(CHUNK, len(own) - at)
        v, w = x[:n], y[:n]
        np.multiply(own[at:at + n, None], _A, out=v)
        v += _B
        np.right_shift(v, np.uint64(31), out=w)
        v &= prime
        v += w
        np.subtract(v, prime, out=w)  # wraps to the larger number where v is under the prime
        np.minimum(v, w, out=v)
        np.minimum(low, v.min(axis=0), out=low)
    return low.astype(np.int64)


def _signer(sign):
    @pandas_udf(SIGNED)
    def signed(view: pd.Series) -> pd.DataFrame:
        out, sizes = [], []
        for v in view:  # one text's hashes at a time
            found = shingle_hashes(v or "")
            out.append(sign(found))
            sizes.append(len(found))
        return pd.DataFrame({"signature": out, "shingles": sizes})

    # else Spark puts a filter on the number of shingles below, and signs every text twice, in two more Python workers a task
    return signed.asNondeterministic()


_sign, _permute = _signer(minhash), _signer(permuted)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", sign=_sign) -> DataFrame:
    """(key, signature, shingles) of each text, over its whole normalised form; null counts as empty."""
    rows = texts(docs).select(key, sign(shingle_view(F.coalesce(F.col(text), F.lit("")))).alias("s"))
    return rows.select(key, "s.signature", "s.shingles")


def permuted_signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signature, shingles) as ``signatures`` gives them, each place of a signature from a permutation of its own."""
    return signatures(docs, key, text, _permute)


def _part(signature: Column, k: Column, bands: int) -> Column:
    rows = F.floor(F.size(signature) / bands).cast("int")
    return F.slice(signature, k * rows + 1, rows)


def band_keys(signature: Column, bands: int = BANDS) -> Column:
    """A digest for each band of a signature; none for an empty one."""
    digest = lambda k: F.substring(F.md5(F.array_join(_part(signature, k, bands).cast("array<string>"), ",")), 1, 16)
    return F.when(F.size(signature) > 0, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.concat(k.cast("string"), F.lit(":"), digest(k)))).otherwise(F.array().cast("array<string>"))


def differing(left: Column, right: Column) -> Column:
    """The number of places in which two signatures differ."""
    return F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d))


def _measured(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, d) of the pairs (a, b): in how many places their signatures differ."""
    side = lambda k: classes.select(F.col("class_id").alias(k), F.col("signature").alias(f"{k}_s"))
    met = broadcast_within(pairs).join(side("a"), "a").join(side("b"), "b")
    return cut(met.select("a", "b", differing(F.col("a_s"), F.col("b_s")).alias("d")))


def class_links(classes: DataFrame, least: float = LEAST, bands: int = BANDS, stars: int = 2) -> DataFrame:
    """(a, b, similarity): links between classes (class_id, signature) of a cut table that share a band and agree in ``least`` of
    their places, enough of them to connect all that such links connect.

    In each bucket of a band the smallest class is compared with all others first, and ``stars`` - 1 times that of those
    still outside the largest component; at last all of these with the others of the bucket. Places differ like a distance:
    two classes cannot be nearer than their distances to the bucket's first class are apart, which spares most of the last
    comparisons. So a bucket of near copies costs a comparison a class, and is spread over tasks by pairs, not by bucket.
    """
    most = F.lit((1 - least) * PLACES)
    buckets = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(_part(F.col("signature"), k, bands))))
    rows = classes.select("class_id", buckets.alias("band", "bucket"))
    heads = rows.groupBy("band", "bucket").agg(F.min("class_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = cut(rows.join(heads, ["band", "bucket"]))
    first = _measured(rows.where("class_id <> head").select(F.col("head").alias("a"), F.col("class_id").alias("b")).distinct(), classes)
    rows = rows.join(broadcast_within(first), (F.col("head") == F.col("a")) & (F.col("class_id") == F.col("b")), "left")
    rows = cut(rows.select("band", "bucket", "class_id", F.coalesce("d", F.lit(0)).alias("far")))
    found = [first.where(F.col("d") <= most)]
    for k in range(stars):
        roots = cut(connected_components(reduce(DataFrame.union, found).select("a", "b")))
        placed = rows.join(broadcast_within(roots), F.col("class_id") == F.col("node"), "left").select("band", "bucket", "class_id", "far", F.coalesce("root", "class_id").alias("root"))
        by = ["band", "bucket"]
        largest = placed.groupBy(*by, "root").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        mixed = cut(placed.join(largest, by))
        left = mixed.where("root <> most").select(*by, F.col("class_id").alias("v"), F.col("far").alias("v_far"), F.col("root").alias("v_root"))
        if k + 1 < stars:
            left = left.groupBy(*by).agg(F.min(F.struct("v", "v_far", "v_root")).alias("h")).select(*by, "h.*")
        met = mixed.join(left, by).where("root <> v_root").where((F.col("root") == F.col("most")) | (F.col("v") < F.col("class_id")) | F.lit(k + 1 < stars))
        met = met.where(F.abs(F.col("far") - F.col("v_far")) <= most).select(F.col("v").alias("a"), F.col("class_id").alias("b")).distinct()
        found.append(_measured(met, classes).where(F.col("d") <= most))
    return reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (1 - F.col("d") / PLACES).alias("similarity")).distinct()


def usable_classes(signed: DataFrame, key: str = "doc_id", usable: int = USABLE) -> tuple[DataFrame, DataFrame]:
    """(rows, classes), both cut: (key, signature) of texts of ``usable`` shingles or more, and (class_id, signature, members) of
    each different signature, named after its smallest key."""
    rows = cut(signed.where((F.col("shingles") >= usable) & F.col(key).isNotNull()).select(key, "signature"))
    return rows, cut(rows.groupBy("signature").agg(F.min(key).alias("class_id"), F.count("*").alias("members")))


def text_links(signed: DataFrame, key: str = "doc_id", least: float = LEAST, bands: int = BANDS, usable: int = USABLE, stars: int = 2) -> DataFrame:
    """(key, class_id, members, family) of each usable text: its class of equal signatures, the class's size, and the smallest
    class that it reaches over links (``class_links``). Classes stand for their copies, so copies meet nobody. Rows without
    a key are left out."""
    rows, classes = usable_classes(signed, key, usable)
    roots = cut(connected_components(class_links(classes, least, bands, stars).select("a", "b")))
    named = classes.join(broadcast_within(roots), F.col("class_id") == F.col("node"), "left").select("signature", "class_id", "members", F.coalesce("root", "class_id").alias("family"))
    return rows.join(named, "signature").select(key, "class_id", "members", "family")


def _near(left: np.ndarray, right: np.ndarray, band: int, least: float, bands: int, one: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """How many rows of the other side each row agrees with in ``least`` of its places, where ``band`` is the first band that
    both share; and pairs (row of the left, row of the right) of these, no more than connect all that they connect. Sides are
    signatures row by row, the same rows if ``one``; few rows of the left are compared at a time."""
    wide, turned = left.shape[1] // bands, np.ascontiguousarray(right.T)
    mine, theirs = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    behind = 0 if one else len(left)
    label, edges = np.arange(behind + len(right)), []
    for at in range(0, len(left), 64):
        part = left[at:at + 64]
        same, open_ = np.zeros((len(part), len(right)), np.uint16), np.ones((len(part), len(right)), bool)
        for k in range(bands):
            here = np.zeros(same.shape, np.uint8)
            for p in range(k * wide, (k + 1) * wide):
                here += part[:, p, None] == turned[p]
            same += here
            if k <= band:
                open_ &= (here == wide) == (k == band)
        hit = open_ & (same >= least * left.shape[1])
        mine[at:at + 64] = hit.sum(1)
        theirs += hit.sum(0)
        for i in np.flatnonzero(mine[at:at + 64]):
            near = np.flatnonzero(hit[i])
            near = near[label[behind + near] != label[at + i]]
            if len(near):
                joined, first = np.unique(label[behind + near], return_index=True)
                edges += [(at + i, j) for j in near[first]]
                label[np.isin(label, joined)] = label[at + i]
    return mine, theirs, edges


def _counted(least: float, bands: int):
    """Batches (band, bucket, i, j, own, class_id, signature), sorted by the first four -> (class_id, links, near) of the pairs
    between two parts of a bucket: numbers of links, and links to ``near`` that connect the same classes as all of them."""
    made = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["class_id", "links", "near"])

    def found(key, rows):
        band, _, i, j = key
        sides = [[r for r in rows if r[0] == k] for k in ((i,) if i == j else (i, j))]
        ids = [np.array([r[1] for r in s], np.int64) for s in sides]
        marks = [np.frombuffer(b"".join(r[2] for r in s), np.int64).reshape(len(s), -1) for s in sides if s]
        if len(marks) < len(sides):
            return
        mine, theirs, edges = _near(marks[0], marks[-1], band, least, bands, i == j)
        for names, n in ((ids[0], mine - (band == 0)),) if i == j else ((ids[0], mine), (ids[1], theirs)):  # a class shares its first band with itself
            yield made(names[n > 0], n[n > 0], [None] * int((n > 0).sum()))
        if edges:
            a, b = np.array(edges).T
            yield made(ids[0][a], np.zeros(len(a), np.int64), ids[-1][b])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            *key, own, ids, signed = (batch.column(k).to_pylist() for k in range(7))
            for k, *row in zip(zip(*key), own, ids, signed):
                if k != now:
                    if len(rows) > 1:
                        yield from found(now, rows)
                    now, rows = k, []
                rows.append(row)
        if len(rows) > 1:
            yield from found(now, rows)

    return run


@pandas_udf(T.BinaryType())
def _packed(signature: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(s, np.int64).tobytes() for s in signature], dtype=object)


def counted_links(signed: DataFrame, key: str = "doc_id", least: float = LEAST, bands: int = BANDS, usable: int = USABLE, block: int = BLOCK) -> DataFrame:
    """(key, class_id, members, links, family) of each usable text: its class of equal signatures, the class's size, how many other
    classes share a band with it and agree in ``least`` of the places, and the smallest class that it reaches over such links.

    Classes stand for their copies, so copies meet nobody. A bucket of any size is cut into parts of about ``block`` classes,
    and every two parts are compared in a task of their own, so that no pair is left out and no task holds a large bucket; a
    pair counts under the first band that it shares. Two parts give no more links to the families than connect their classes.
    """
    rows, classes = usable_classes(signed, key, usable)
    buckets = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(_part(F.col("signature"), k, bands))))
    banded = classes.select("class_id", buckets.alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("band", "bucket", F.ceil(F.col("n") / block).cast("long").alias("parts"))
    dealt = cut(banded.join(shared, ["band", "bucket"]))
    packed = classes.join(dealt.select("class_id").distinct(), "class_id", "left_semi").select("class_id", _packed("signature").alias("signature"))
    dealt = dealt.join(packed, "class_id").withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    by = ["band", "bucket", "i", "j"]
    dealt = dealt.select(F.col("band").cast("long").alias("band"), "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id", "signature")
    met = cut(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_counted(least, bands), "class_id long, links long, near long"))
    links = met.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = cut(connected_components(met.where("near is not null"), "class_id", "near"))
    found = classes.join(links, "class_id", "left").join(broadcast_within(roots), F.col("class_id") == F.col("node"), "left")
    found = found.select("signature", "class_id", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class_id").alias("family"))
    return rows.join(found, "signature").select(key, "class_id", "members", "links", "family")


def text_edges(signed: DataFrame, key: str = "doc_id", least: float = LEAST, bands: int = BANDS, usable: int = USABLE) -> DataFrame:
    """Edges (a, b, method, score) of the duplicate graph: links between classes, and from each class to its copies."""
    rows, classes = usable_classes(signed, key, usable)
    between = class_links(classes, least, bands).select("a", "b", F.col("similarity").alias("score"))
    copies = rows.join(classes, "signature").where(F.col(key) != F.col("class_id")).select(F.col("class_id").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("score"))
    return between.union(copies).select("a", "b", F.lit("text_minhash").alias("method"), "score")
