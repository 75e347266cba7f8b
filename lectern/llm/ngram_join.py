"""Jaccard join of texts' word n-grams by vertical partitioning: the global order of n-grams is cut into fragments, overlaps are
counted inside each and summed per pair."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import BATCH_BYTES, hashes_among
from lectern.operators.components import connected_components
from lectern.storage import broadcast_within, cut, delete, park_at, texts

#: Words of an n-gram; the least similarity as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: Fragments of the n-gram order in which overlaps of pairs are counted, and rounds of stars before the pairs that are left.
FRAGMENTS, STARS = 8, 2
#: Odd factors of an n-gram's words.
_FACTORS = [np.uint64(int(v) | 1) for v in np.random.Generator(np.random.PCG64(11)).integers(1 << 63, size=32, dtype=np.uint64)]
SKETCH = T.StructType().add("key", T.BinaryType()).add("short", T.LongType()).add("n", T.LongType())


class _Words(dict):
    """Word -> hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 7)
        return out


_HASHES = _Words()


def grams(text: str | bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams of ``width`` words: the words' hashes times a factor for each place,
    summed and mixed. Fewer words are one n-gram, no words none. A-Z are lower-cased, words end at ASCII white space."""
    words = (text.encode("utf-8", "replace") if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    wide = min(width, len(own))
    out = own[:len(own) - wide + 1] * _FACTORS[0]
    for k in range(1, wide):
        out += own[k:len(own) - wide + 1 + k] * _FACTORS[k]
    out += np.uint64(width - wide)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _sketch(width: int):
    @pandas_udf(SKETCH)
    def sketched(text: pd.Series) -> pd.DataFrame:
        found = [grams(t, width) for t in text]
        keys = [xxhash.xxh3_128_digest(g.tobytes()) for g in found]
        return pd.DataFrame({"key": keys, "short": [int.from_bytes(k[:8], "little", signed=True) for k in keys], "n": [len(g) for g in found]})

    return sketched


def _fragments(pieces: int, width: int):
    """Batches (text) -> for blocks of texts and each of ``pieces`` fragments of the order: 32 bits of the n-grams that one set
    of the block has, set by set (``ids``, ``counts``, ``single``), those that several have (``several``), and how many of these
    each set has (``sure_ids``, ``sure``). A set that stands in a block several times is sent once, and so is an n-gram."""

    def block(sets):
        ids = np.array(list(sets), np.int64)
        sizes = [len(g) for g in sets.values()]
        every, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
        place = ((every >> np.uint64(40)) * np.uint64(pieces) >> np.uint64(24) << np.uint64(32)) | (every & np.uint64(0xFFFFFFFF))
        order = np.argsort(place, kind="stable")
        ranked = place[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        alone = first & np.concatenate([first[1:], [True]])
        single = np.zeros(len(every), bool)
        single[order[alone]] = True
        several = ranked[first & ~alone]
        sure = np.bincount(owner[~single], minlength=len(sets))
        # set by set inside a fragment: places of one set already ascend
        where, own, what = (place >> np.uint64(32)).astype(np.int32)[single], owner[single], place[single].astype(np.uint32)
        by = np.lexsort((own, where))
        where, own, what = where[by], own[by], what[by]
        turn = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (own[1:] != own[:-1])])) if len(what) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([turn, [len(what)]])).astype(np.int32)
        runs, cuts = np.searchsorted(where[turn], np.arange(pieces + 1)), np.searchsorted(where, np.arange(pieces + 1))
        many = np.searchsorted((several >> np.uint64(32)).astype(np.int64), np.arange(pieces + 1))
        low = several.astype(np.uint32)
        has = np.flatnonzero(sure)
        mine = int(ids[0]) % pieces  # one fragment's row carries what the block knows for sure
        rows = []
        for f in range(pieces):
            if cuts[f] < cuts[f + 1] or many[f] < many[f + 1] or f == mine:
                t = slice(runs[f], runs[f + 1])
                rows.append((f, ids[own[turn[t]]].tobytes(), counts[t].tobytes(), what[cuts[f]:cuts[f + 1]].tobytes(), low[many[f]:many[f + 1]].tobytes(), ids[has].tobytes() if f == mine else b"", sure[has].astype(np.int32).tobytes() if f == mine else b""))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 6)], names=["fragment", "ids", "counts", "single", "several", "sure_ids", "sure"])

    def run(batches):
        sets, held = {}, 0
        for batch in batches:
            for text in batch.column(0):
                if len(own := grams(text.as_buffer() and text.as_buffer().to_pybytes() if text.is_valid else None, width)):
                    short = int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:8], "little", signed=True)
                    if short not in sets:
                        sets[short] = own
                        held += own.nbytes
                if held > BATCH_BYTES:
                    yield block(sets)
                    sets, held = {}, 0
        if sets:
            yield block(sets)

    return run


def _shared(pieces: int):
    """Rows of _fragments, sorted by fragment -> (bucket, ids, shared): how many n-grams of each set others have in a fragment,
    packed by ``pieces`` buckets of sets, so that a fragment gives a row for each bucket and not one for each set."""
    names = ("ids", "counts", "single", "several", "sure_ids", "sure")

    def counted(parts):
        whole = {n: b"".join(p) for n, p in zip(names, zip(*parts))}
        ids, counts = np.frombuffer(whole["ids"], np.int64), np.frombuffer(whole["counts"], np.int32)
        single, several = (np.frombuffer(whole[n], np.uint32) for n in ("single", "several"))
        ranked = np.sort(np.concatenate([single, several, several]))
        more = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        at = np.minimum(np.searchsorted(more, single), max(len(more) - 1, 0))
        hit = more[at] == single if len(more) else np.zeros(len(single), bool)
        sums = np.add.reduceat(hit, np.cumsum(counts) - counts, dtype=np.int64) if len(counts) else np.zeros(0, np.int64)
        ids = np.concatenate([ids[sums > 0], np.frombuffer(whole["sure_ids"], np.int64)])
        sums = np.concatenate([sums[sums > 0], np.frombuffer(whole["sure"], np.int32)]).astype(np.int32)
        bucket = ids % pieces
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(pieces + 1))
        rows = [(k, ids[by[a:b]].tobytes(), sums[by[a:b]].tobytes()) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[], [], []], (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "ids", "shared"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for now, *part in zip(batch.column("fragment").to_pylist(), *columns):
                if now != key:
                    if parts:
                        yield counted(parts)
                    key, parts = now, []
                parts.append(part)
        if parts:
            yield counted(parts)

    return run


def _summed(batches):
    """Rows of _shared, sorted by bucket -> (short, shared), summed over fragments."""

    def out(parts):
        ids, shared = (np.frombuffer(b"".join(p), t) for p, t in zip(zip(*parts), (np.int64, np.int32)))
        each, at = np.unique(ids, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(at, weights=shared, minlength=len(each)).astype(np.int64))], names=["short", "shared"])

    key, parts = None, []
    for batch in batches:
        for now, *part in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if now != key:
                if parts:
                    yield out(parts)
                key, parts = now, []
            parts.append(part)
    if parts:
        yield out(parts)


def _segments(width: int):
    @pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def cut_up(text: pd.Series) -> pd.Series:
        """The n-grams of each fragment of the order."""
        out = []
        for t in text:
            own = grams(t, width)
            ends = np.searchsorted((own >> np.uint64(61)).astype(np.int64) * FRAGMENTS // 8, np.arange(FRAGMENTS + 1))
            out.append([own[a:b].view(np.int64) for a, b in zip(ends, ends[1:])])
        return pd.Series(out)

    return cut_up


def sharers(docs: DataFrame, classes: DataFrame, width: int, least: tuple[int, int], pieces: int) -> DataFrame:
    """The classes of which others may hold ``least`` of the n-grams or more; all that have a link are among them.

    The order of all n-grams is cut into ``pieces`` fragments, each counted in one task from 32 bits an n-gram; rare clashes of
    these only let a class stay. No similar text of a class can exist if under ``least`` of its n-grams stand elsewhere.
    """
    num, den = least
    parts = docs.select("text").mapInArrow(_fragments(pieces, width), "fragment int, ids binary, counts binary, single binary, several binary, sure_ids binary, sure binary")
    dealt = parts.repartitionById(pieces, "fragment").sortWithinPartitions("fragment")
    packed = dealt.mapInArrow(_shared(pieces), "bucket int, ids binary, shared binary")
    shared = packed.repartitionById(pieces, "bucket").sortWithinPartitions("bucket").mapInArrow(_summed, "short long, shared long")
    return classes.join(shared, "short").where(F.col("shared") * den >= F.col("n") * num).drop("shared")


def _possible(a: str, b: str, least: tuple[int, int], common: tuple[str, str] | None = None) -> Column:
    """Whether two sets, structs of size ``n``, n-grams that others have ``s`` and the place ``at`` of the n-gram under which they
    meet, can be as similar as ``least`` if that is the first that they share: then they share no more than stand from there
    on. ``common`` names what each has in common with a third set: together they have the smaller of it, and of what others
    have that they have beside it."""
    num, den = least
    left, right = (lambda c, v=v: F.col(f"{v}.{c}") for v in (a, b))
    enough = lambda most: most * (num + den) >= (left("n") + right("n")) * num
    fits = (F.least(left("n"), right("n")) * den >= F.greatest(left("n"), right("n")) * num) & enough(F.least(left("n") - left("at"), right("n") - right("at")))
    if common is None:
        return fits
    x, y = map(F.col, common)
    return fits & F.coalesce(enough(F.least(x, y) + F.least(left("s") - x, right("s") - y)), F.lit(True))


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, common) of the pairs (a, b, na, nb): common n-grams counted fragment by fragment and summed."""
    right = segments.select(F.col("sid").alias("b"), "fragment", F.col("grams").alias("right")).join(broadcast_within(pairs), "b")
    left = segments.select(F.col("sid").alias("a"), "fragment", F.col("grams").alias("left"))
    partial = right.join(left, ["a", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).cast("long").alias("common"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))


def links(segments: DataFrame, least: tuple[int, int] = LEAST, stars: int = STARS) -> DataFrame:
    """Links (a, b) between the sets of ``segments`` (sid, n, fragment, grams) that connect all pairs of a similarity of ``least``
    or more.

    In an order by rising frequency, two such sets share one of their first n - ceil(least * n) + 1 n-grams, so only sets that
    meet under one of these can be near. Under each, the set with the fewest n-grams of its own is compared with all others
    first; then, ``stars`` times in all, that of those outside the largest component; at last all that are still in
    different components with those they meet. Pairs that cannot be near by their sizes, or by what both have in common with
    the first set that they were compared with, are passed over. So a group of near copies gives a few pairs a set, and no
    link is lost.
    """
    num, den = least
    tokens = segments.select("sid", "n", F.explode("grams").alias("gram"))
    common = tokens.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(common, "gram").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("by"))
    whole = F.expr(f"(n * {num} + {den - 1}) div {den}")  # ceil(least * n)
    first = (F.size("by") + 1 - whole).cast("int")  # those that only this set has come before, and meet nobody
    meeting = ranked.where(first > 0).select(F.col("sid"), "n", F.size("by").cast("long").alias("s"), F.posexplode(F.slice("by", F.lit(1), first)).alias("k", "g"))
    held = cut(meeting.select(F.col("g.gram").alias("gram"), F.struct("sid", "n", "s", (F.col("n") - F.col("s") + F.col("k")).alias("at")).alias("x")))
    central = F.struct((F.col("x.n") - F.col("x.s")).alias("own"), F.col("x.sid").alias("sid"), F.col("x").alias("x"))
    apart = lambda v: cut(v.select(F.col("v.sid").alias("a"), F.col("x.sid").alias("b"), F.col("v.n").alias("na"), F.col("x.n").alias("nb")).distinct())
    near = lambda rows: rows.where(F.col("common") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")

    heads = held.groupBy("gram").agg(F.min(central).alias("v"), F.count("*").alias("n")).where("n > 1").select("gram", "v.x").withColumnRenamed("x", "v")
    meet = held.join(heads, "gram")
    first = cut(overlaps(apart(meet.where("x.sid <> v.sid").where(_possible("v", "x", least))), segments))
    found = [near(first)]
    # each row with what its set has in common with the first head that it met, where that was counted
    known = broadcast_within(first.select("a", "b", "common"))
    held = cut(meet.join(known, (F.col("v.sid") == F.col("a")) & (F.col("x.sid") == F.col("b")), "left").select("gram", "x", F.when(F.col("x.sid") == F.col("v.sid"), F.col("x.s")).otherwise(F.col("common")).alias("common")))
    for k in range(stars):
        roots = cut(connected_components(reduce(DataFrame.union, found)))
        placed = held.join(broadcast_within(roots), F.col("x.sid") == F.col("node"), "left").select("gram", "x", "common", F.coalesce("root", "x.sid").alias("root"))
        largest = placed.groupBy("gram", "root").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("gram", "most")
        mixed = cut(placed.join(largest, "gram"))
        left = mixed.where("root <> most").select("gram", F.col("x").alias("v"), F.col("root").alias("other"), F.col("common").alias("beside"))
        if k + 1 < stars:  # one of those outside the largest component
            of = F.struct((F.col("v.n") - F.col("v.s")).alias("own"), F.col("v.sid").alias("sid"), "v", "other", "beside")
            left = left.groupBy("gram").agg(F.min(of).alias("h")).select("gram", "h.v", "h.other", "h.beside")
        met = mixed.join(left, "gram").where("root <> other").where((F.col("root") == F.col("most")) | (F.col("v.sid") < F.col("x.sid")) | F.lit(k + 1 < stars))
        found.append(cut(near(overlaps(apart(met.where(_possible("v", "x", least, ("beside", "common")))), segments))))
    return reduce(DataFrame.union, found)


def grouped(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST, key: str = "doc_id", text: str = "text", stars: int = STARS, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two cut tables: (doc_id, text_hash, key, short, n) of each row, ``key`` naming its set of n-grams, ``n`` their number; and
    (key, root) of the sets that are linked with others, ``root`` naming what they reach. With ``among`` (doc_id, text_hash) only
    these rows, and links between them; the other rows' n-grams are counted by ``sharers``, so that texts need not be dealt
    to leave them out, and can only let a set stay there."""
    spark = docs.sparkSession
    docs = texts(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _sketch(width)("text").alias("s")).select("doc_id", "text_hash", "s.*")
    rows = cut(rows if among is None else hashes_among(rows, among))
    classes = cut(rows.where("n > 0").groupBy("key").agg(F.first("short").alias("short"), F.first("n").alias("n"), F.min("text_hash").alias("text_hash")))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stay = cut(sharers(docs, classes, width, least, pieces).withColumn("sid", F.monotonically_increasing_id()))
    named = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(broadcast_within(stay.select("text_hash", "sid", "n")), "text_hash").dropDuplicates(["sid"])
    segments, path = park_at(named.select("sid", "n", F.posexplode(_segments(width)("text")).alias("fragment", "grams")).where("size(grams) > 0"))
    roots = cut(connected_components(links(segments, least, stars)))
    delete(spark, path)
    return rows, cut(stay.join(roots, stay["sid"] == roots["node"]).select("key", "root"))


def similar_texts(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST, key: str = "doc_id", text: str = "text", stars: int = STARS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: its number of distinct n-grams of ``width`` words, and the smallest
    doc_id that it reaches over links of a Jaccard similarity of ``least`` or more.

    Texts with the same n-grams are one class, told apart by 128 bits, and meet others once; n-grams are equal if their 64
    bits are. Texts of fewer words are one n-gram and link with their equals; null and empty texts and such without words
    have no n-grams and link with nothing, so each is its own component. A null doc_id gets its group's smallest other one, null
    if there is none; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    rows, linked = grouped(docs, width, least, key, text, stars)
    first = cut(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")))
    member = linked.join(first, "key")
    best = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    ends = first.join(best, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    found = rows.where("n > 0").join(ends, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
