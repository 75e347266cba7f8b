"""SimHash near-duplicates: fingerprints, exact radius search by bit-sliced comparison, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import only_rows
from lectern.operators.components import connected_components
from lectern.storage import broadcast_within, cut, texts

BITS = 64
#: Pairs that are compared at once, lanes of a block, and planes between two looks at whether a block can be left.
PAIRS, LANES, LOOK = 1 << 19, 4096, 8


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included: a bit is set if it is set in over half of their XXH64.
    A text of fewer words has one shingle, a text without words the fingerprint 0. A-Z are lower-cased, words end at
    ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, seed) for g in grams], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """A number whose bits are those that over half of the numbers have set."""
    counts, size = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, size, 1 << 16):
        counts += np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > size, bitorder="little").view("<u8")[0])


@pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    """Fingerprints with the bit pattern of a signed long."""
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def planes(values: np.ndarray) -> np.ndarray:
    """[64, words]: bit i of the values as a row of bits, padded with zeros."""
    bits = np.zeros((-(-len(values) // 64) * 64, BITS), np.uint8)
    bits[:len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def beyond(differing: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes of [64, words] difference planes in which more than ``radius`` planes are set.

    The planes are added into a binary counter of every lane at once, a bit of it a word (carry-save); a carry out of the
    counter marks the lane for good. After every few planes, the blocks all of whose lanes are marked are left.
    """
    per = LANES // 64
    blocks = -(-differing.shape[1] // per)
    width = radius.bit_length()
    full = np.uint64(2**64 - 1)
    out = np.full((blocks, per), full)
    d = np.zeros((BITS, blocks * per), np.uint64)
    d[:, :differing.shape[1]] = differing
    d = d.reshape(BITS, blocks, per)
    live = np.arange(blocks)
    tail = np.zeros((blocks, per), np.uint64)
    tail.reshape(-1)[differing.shape[1]:] = full
    count, over = [np.zeros((blocks, per), np.uint64) for _ in range(width)], tail
    for i in range(BITS):
        carry = d[i][live] if len(live) < blocks else d[i]
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over = over | carry
        if i % LOOK == LOOK - 1:
            stay = (over != full).any(axis=1)
            if not stay.all():
                live, over, count = live[stay], over[stay], [c[stay] for c in count]
                if not len(live):
                    break
    more, same = np.zeros_like(over), np.full_like(over, full)
    for k in reversed(range(width)):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more, same = more | same & count[k], same & ~count[k]
    out[live] = over | more
    return out.reshape(-1)[:differing.shape[1]]


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def _small_groups(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """Arrays (left, right) of the pairs inside small groups that are near."""
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        per = max(1, PAIRS // len(i))
        at = starts[sizes == size]
        for k in range(0, len(at), per):
            a, b = (values[(at[k:k + per, None] + x).reshape(-1)] for x in (i, j))
            near = ~_lanes(beyond(planes(a ^ b), radius), len(a))
            yield a[near], b[near]


def _large_group(values: np.ndarray, radius: int):
    """Arrays (left, right) of links that connect a group as its near pairs do: each value is compared once with those
    not reached yet, which are linked to it and looked from next."""
    p, n = planes(values), len(values)
    waiting = np.ones(n, bool)
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        todo = [first]
        while todo and waiting.any():
            q = todo.pop()
            mask = np.where(np.unpackbits(values[q:q + 1].astype("<u8").view(np.uint8), bitorder="little").astype(bool), np.uint64(2**64 - 1), np.uint64(0))
            near = ~_lanes(beyond(p ^ mask[:, None], radius), n) & waiting
            hit = np.flatnonzero(near)
            waiting[hit] = False
            todo.extend(hit.tolist())
            yield np.repeat(values[q:q + 1], len(hit)), values[hit]


def _search(radius: int, small: int = 32):
    """Batches sorted by (key, i, j) -> batches of links inside each of these groups."""

    def links(batches):
        held = None
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
            held = table if held is None else np.concatenate([held, table], axis=1)
            change = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0))
            if len(change):  # the last group may go on in the next batch
                yield from found(held[:, :change[-1] + 1])
                held = held[:, change[-1] + 1:]
        if held is not None and held.shape[1]:
            yield from found(held)

    def found(table):
        values = table[3].view(np.uint64)
        bounds = np.flatnonzero(np.concatenate([[True], (table[:3, 1:] != table[:3, :-1]).any(axis=0), [True]]))
        sizes, starts = np.diff(bounds), bounds[:-1]
        few = (sizes > 1) & (sizes <= small)
        pairs = [*_small_groups(values, starts[few], sizes[few], radius)]
        for at, n in zip(starts[sizes > small], sizes[sizes > small]):
            pairs += _large_group(values[at:at + n], radius)
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links


def near_links(prints: DataFrame, radius: int = 3, blocks: int = 5, block_rows: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` of a cut table that connect all that differ in ``radius`` bits or fewer.

    The 64 bits fall into ``blocks`` blocks. Two fingerprints within the radius agree in at least blocks - radius of
    them, so they meet under the key of one of the choices of so many blocks. Inside a key, fingerprints are compared bit
    plane by bit plane. Keys with more than ``block_rows`` fingerprints are split into parts, and every pair of parts is
    compared on its own, so no task holds a large key; nothing is left out.
    """
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edge[b + 1]) - (1 << edge[b])) for b in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    members = prints.select("fp", F.explode(keys).alias("key"))
    shared = cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    rows = members.join(broadcast_within(shared, 50_000), "key").withColumn("parts", parts).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "fp")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_search(radius), "a long, b long")


def _grouped(docs: DataFrame, radius: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of each document and (fp, root, component_id) of each fingerprint, both cut."""
    rows = cut(texts(docs).select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), simhash(text).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(connected_components(near_links(prints, radius)))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, cut(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each document: its fingerprint and the smallest doc_id that it reaches over links of
    ``radius`` or fewer differing bits.

    Copies share a fingerprint and are searched once. Null text and text without words have the fingerprint 0 and are
    linked like others; a null doc_id gets its group's smallest other one (null if there is none); repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    rows, groups = _grouped(docs, radius, key, text)
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One document of each group of near-duplicates, with all columns: that with the smallest doc_id (null last), of
    several texts under it that with the smallest hash. Rows that repeat its doc_id and text stay one row.

    Groups are told apart by their fingerprints, so documents without a doc_id are not mixed up, and a doc_id that stands
    for texts of several groups is kept once for each. Null and empty texts are one group; columns of any name are kept; an
    empty table stays empty.
    """
    return only_rows(docs, first_rows(docs, radius))


def first_rows(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, text_hash) of the rows that ``keep_first`` keeps, cut; no text is dealt for them."""
    rows, groups = _grouped(docs, radius, "doc_id", "text")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = rows.groupBy("fp").agg(F.min(first).alias("first")).join(groups, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return cut(best.select("first.doc_id", "first.text_hash"))
