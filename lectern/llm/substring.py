"""Substring dedup over sliding runs of sentences and chosen runs of words."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.llm.common import BATCH_BYTES
from lectern.storage import cut, park, texts

#: A sentence ends behind its closing marks before white space, or with its line.
END = re.compile(r"(?<=[.!?。！？])\s+|\n+")
#: Longer sentences are cut behind words that their content chooses, one in eight, so equal passages are cut alike.
LONG, CHOICE = 16, 8
#: A run: so many consecutive sentences at least, and so many words.
SENTENCES, WORDS = 3, 25
WORD = re.compile(r"\S+")
#: Words of a gram, and consecutive grams of which at least one is chosen. A stretch of GRAM + WINDOW - 1 = 51 words holds
#: WINDOW whole grams, so one is chosen in it, and by its content alone.
GRAM, WINDOW = 26, 26
#: Bits for each repeated hash, and of all at most, by which others are passed over; and bits of a piece.
MARKS, MOST_MARKS, PIECE = 16, 1 << 30, 1 << 15
SPAN = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())
CLEANED = T.StructType().add("removed", T.IntegerType()).add("spans", T.ArrayType(SPAN)).add("text", T.StringType())


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each sentence with words, in order; the ends are without the white space behind."""
    out, at = [], 0
    for m in [*END.finditer(text), None]:
        stop = m.start() if m else len(text)
        piece = text[at:stop]
        n = len(piece.split())
        if n > LONG:
            start = count = 0
            for w in WORD.finditer(piece):
                if not count:
                    start = w.start()
                count += 1
                if not zlib.crc32(w.group().encode("utf-8", "replace")) % CHOICE:
                    out.append((at + start, at + w.end(), count))
                    count = 0
            if count:
                out.append((at + start, stop, count))
        elif n:
            out.append((at, stop, n))
        at = m.end() if m else stop
    return out


def runs(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """(hash, characters that it covers) of the run from each sentence on: the shortest of at least SENTENCES sentences and
    WORDS words, up to the next sentence. Sentences near the end that start no such run have none. Hashes ignore case and
    the kind of white space."""
    found = sentences(text)
    if len(found) < SENTENCES:
        return [], []
    said = [b" ".join(text[a:b].lower().encode("utf-8", "replace").split()) for a, b, _ in found]
    starts = [a for a, *_ in found] + [len(text)]
    hashes, covers = [], []
    last, words = 0, 0
    for first in range(len(found)):
        while last < len(found) and (words < WORDS or last - first < SENTENCES):
            words += found[last][2]
            last += 1
        if words < WORDS or last - first < SENTENCES:
            break
        hashes.append(xxhash.xxh3_64_intdigest(b"\n".join(said[first:last])) - (1 << 63))
        covers.append((starts[first], starts[last]))
        words -= found[first][2]
    return hashes, covers


def _chosen(values: np.ndarray) -> np.ndarray:
    """Positions of the values that are least in some WINDOW consecutive ones. Of equal values so few are taken that each
    window still has one."""
    n, low, size = len(values), values, 1
    while 2 * size <= WINDOW:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:n - WINDOW + 1], low[WINDOW - size:])
    lows = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)])
    high, size = lows, 1  # at p: the largest of the minima of the windows that hold p
    while 2 * size <= WINDOW:
        high, size = np.maximum(high[:-size], high[size:]), 2 * size
    high = np.maximum(high[:n], high[WINDOW - size:])
    at = np.flatnonzero(values == high)
    if len(np.unique(values[at])) == len(at):
        return at
    keep, last, then = np.ones(len(at), bool), {}, {}
    following = np.full(len(at), n + WINDOW)
    for k in range(len(at) - 1, -1, -1):
        following[k] = then.get(v := int(values[at[k]]), n + WINDOW)
        then[v] = at[k]
    for k, p in enumerate(at.tolist()):
        v = int(values[p])
        if v in last and following[k] - last[v] <= WINDOW:
            keep[k] = False
        else:
            last[v] = p
    return at[keep]


def grams(text: str) -> tuple[list[int], list[int]]:
    """(hash, first word) of chosen runs of GRAM words, without regard to sentences, case and the kind of white space: any
    WINDOW consecutive runs have one. Texts too short for a passage of over 50 words have none."""
    words = text.lower().split()
    if len(words) < GRAM + WINDOW - 1:
        return [], []
    one = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in set(words)}
    each = np.array([one[w] for w in words], np.uint64)
    n = len(each) - GRAM + 1
    values = np.zeros(n, np.uint64)
    for k in range(GRAM):
        values = values * np.uint64(0x9E3779B97F4A7C15) + each[k:k + n]
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    at = _chosen(values)
    return values[at].view(np.int64).tolist(), at.tolist()


def spans_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """(hash, range) of all runs of a text, and the ranges of those that repeat an earlier one of it: a run of words does so
    only behind that one's end. A range is its first character in the upper, its end in the lower 32 bits."""
    (hashes, covers), (more, at) = runs(text), grams(text)
    ranges = [a << 32 | b for a, b in covers]
    seen: set[int] = set()
    again = [r for h, r in zip(hashes, ranges) if h in seen or seen.add(h)]
    if more:
        edges = [*(m.start() for m in WORD.finditer(text)), len(text)]
        words = [edges[p] << 32 | edges[p + GRAM] for p in at]
        ahead: dict[int, int] = {}
        again += [r for h, p, r in zip(more, at, words) if p >= ahead.setdefault(h, p) + GRAM]
        hashes, ranges = hashes + more, ranges + words
    return hashes, ranges, again


def _parsed(batches):
    """(doc_id, place, text_hash, text) -> (doc_id, place, text_hash, hashes, ranges, again) for texts with runs."""
    long, longs = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("doc_id", long), ("place", long), ("text_hash", long), ("hashes", longs), ("ranges", longs), ("again", longs)])
    for batch in batches:
        rows, held = [], 0
        for doc, place, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            hashes, ranges, again = spans_of(text.as_py() or "")
            if not hashes:
                continue
            rows.append((doc, place, mark, hashes, ranges, again))
            held += 16 * len(hashes)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def without(text: str, ranges) -> tuple[int, list[dict], str]:
    """(characters that go, merged spans, what stays) of a text without ranges."""
    spans, kept, at = [], [], 0
    for r in sorted(ranges):
        start, stop = int(r) >> 32, int(r) & 0xFFFFFFFF
        if spans and spans[-1][1] >= start:
            spans[-1][1] = max(stop, spans[-1][1])
        else:
            spans.append([start, stop])
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    kept.append(text[at:])
    left = "".join(kept)
    return sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], left.rstrip() if spans and spans[-1][1] == len(text) else left


@pandas_udf(CLEANED)
def _without(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out = [(0, [], None) if t is None else without(t, r) for t, r in zip(text, ranges)]
    return pd.DataFrame(out, columns=["removed", "spans", "text"])


#: Called nondeterministic so that Spark pushes no filter on its result below it, which would cut every text twice, in two
#: Python workers a task.
_cut = _without.asNondeterministic()


def placed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, text): the rows as structs. ``place`` numbers the rows without doc_id, which are parked with
    their numbers, so that each of them is a document of its own; other rows have none."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    named = docs.where(docs["doc_id"].isNotNull()).select(row, F.lit(None).cast("long").alias("place"))
    unnamed = park(docs.where(docs["doc_id"].isNull()).select(row, F.monotonically_increasing_id().alias("place")))
    return named.union(unnamed).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), "place", F.col("row.text").alias("text"))


def marked(each: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of ``each`` whose ``hash`` may stand in the cut table ``shared``: all that do, and about one in MARKS of the others.
    Each shared hash sets a bit; the bits are broadcast in pieces, so rows that find theirs unset are dealt nowhere."""
    size = PIECE * max(1, min(MARKS * shared.count(), MOST_MARKS) // PIECE)
    piece, word, bit = (F.expr(x.format(f"pmod(hash, {size}L)")) for x in (f"{{}} div {PIECE}", f"cast({{}} % {PIECE} div 64 as int)", "shiftleft(1L, cast({} % 64 as int))"))
    none = each.sparkSession.range(size // 64).select(F.expr(f"id div {PIECE // 64}").alias("piece"), F.expr(f"cast(id % {PIECE // 64} as int)").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = shared.select(piece.alias("piece"), word.alias("word"), bit.alias("bit")).union(none).groupBy("piece", "word").agg(F.bit_or("bit").alias("bits"))
    pieces = words.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))
    return each.join(F.broadcast(cut(pieces)), piece == F.col("piece")).where(F.get("words", word).bitwiseAND(bit) != 0).drop("piece", "words")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, place, text_hash, ranges): for the documents with repeated runs, the ranges of those that are not the first
    with their hash. First is the smallest doc_id, behind these the smallest place of rows without one, inside a document
    the earliest.

    Every run is hashed. Minimum and maximum of doc_id and place are aggregated by hash before any join, and only hashes of
    two documents or more are joined back, so a passage of any number of documents is never gathered in one group. Runs whose
    hash is surely in one document are passed over by ``marked`` before they are dealt for that join, which stays exact.
    """
    key = ["doc_id", "place", "text_hash"]
    base = texts(rows).select("doc_id", "place", F.xxhash64("text").alias("text_hash"), "text")
    spans = park(base.mapInArrow(_parsed, "doc_id long, place long, text_hash long, hashes array<long>, ranges array<long>, again array<long>"))
    each = spans.select(*key, F.explode(F.arrays_zip("hashes", "ranges")).alias("run")).select(*key, F.col("run.hashes").alias("hash"), F.col("run.ranges").alias("range"))
    ends = each.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    shared = cut(ends.where("first < last or first_place < last_place or (first is not null and first_place is not null)").select("hash", "first", "first_place"))
    later = marked(each, shared).join(shared, "hash").where("doc_id > first or place > first_place or (doc_id is null and first is not null)").select(*key, "range")
    inside = spans.select(*key, F.explode("again").alias("range"))
    return later.union(inside).groupBy(*key).agg(F.collect_set("range").alias("ranges"))


def cleaned(docs: DataFrame) -> DataFrame:
    """(row, removed, spans, text): each row as a struct, and its text without what non-first repeated runs cover.

    Every text is parsed once; only texts with repeated runs go to Python again, with the ranges to cut.
    """
    rows = placed(docs)
    found = repeated_runs(rows).select(F.col("doc_id").alias("_id"), F.col("place").alias("_at"), F.col("text_hash").alias("_hash"), "ranges")
    known = rows["doc_id"].eqNullSafe(found["_id"]) & rows["place"].eqNullSafe(found["_at"]) & (F.xxhash64(rows["row.text"]) == found["_hash"])
    joined = rows.drop("text").join(found, known, "left").select("row", "ranges")  # the text is in the row and dealt once
    hit = F.col("ranges").isNotNull()
    new = joined.select("row", hit.alias("hit"), _cut(F.when(hit, F.col("row.text")), "ranges").alias("new"))
    return new.select("row", "new.removed", "new.spans", F.when(F.col("hit"), F.col("new.text")).otherwise(F.col("row.text")).alias("text"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(all columns but text, removed, spans, text): each document without the sentences and words that a non-first repeated
    run covers; ``spans`` are their character ranges in the old text, ``removed`` is how many characters went.

    A run is three or more consecutive sentences with 25 or more words (sentences over 16 words are first cut behind words
    that the content chooses), or 26 words at a place that the content chooses, at least one in any 51 words. So every
    passage of over 50 words is found wherever it stands and loses at least 26 words; where it starts or ends inside a
    sentence, up to 25 words at either end may stay. Single lines and stock phrases stay. Null text stays null, empty and
    short texts stay. Rows with the same doc_id are versions of one document and do not repeat each other; a row without
    doc_id is a document of its own, behind all with one. An empty table gives an empty result. Other columns are kept;
    columns named ``removed`` and ``spans`` are replaced (``cleaned`` keeps them).
    """
    names = [c for c in docs.columns if c not in ("text", "removed", "spans")]
    return cleaned(docs).select(*[F.col("row")[c].alias(c) for c in names], "removed", "spans", "text")
