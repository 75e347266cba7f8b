"""Vector codes: parts of vectors coded by codebooks that Lloyd's rounds fit, with heaps of slack (Hamerly and Drake, 2015)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import cut, delete, park_at

#: Vectors of a block, which has its own heaps. Positions in a heap are kept in 16 bits.
BLOCK = 4096
#: Sums of integers beyond this many bits are carried in digits of that many bits.
DIGIT = 30
#: Float distances between integer parts are exact while their squares stay below 2 ** 53.
EXACT = 1 << 53


@dataclass
class Codebooks:
    """Entries of each part position (integer rows), and how far each entry's parts may have lost of their slack so far."""

    entries: list[list[list[int]]]
    drift: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for e in book for v in e).encode()).hexdigest()


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component), as int64 where all fit 62 bits, else as Python integers. ``scale`` is a power of two, so the
    product of a float is exact."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    whole = lambda s, v: int(s) if np.isfinite(s) else int(v) * scale
    return np.array([[whole(s, v) for s, v in zip(*rows)] for rows in zip(scaled, vectors)], object).reshape(vectors.shape)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """[parts, entries]: exact squared distances, as floats where these are exact, else as Python integers."""
    most = max((int(abs(a).max()) for a in (parts, book) if a.size), default=0)
    if parts.shape[1] * (2 * most) ** 2 < EXACT:
        x, c = parts.astype(float), book.astype(float)
        return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
    gap = parts.astype(object)[:, None, :] - book.astype(object)[None]
    return (gap * gap).sum(2)


def _whole(rows: list[list[int]]) -> np.ndarray:
    """Integer rows, as int64 where all fit 62 bits."""
    return np.array(rows, np.int64 if all(abs(v) < 1 << 62 for r in rows for v in r) else object)


def _pack(x: np.ndarray) -> tuple[int, bytes]:
    """Bytes an integer, or 0 for decimal text, and the bytes."""
    most = int(abs(x).max()) if x.size else 0
    for width in (2, 4, 8):
        if most < 1 << (8 * width - 1):
            return width, x.astype(f"<i{width}").tobytes()
    return 0, ",".join(map(str, x.reshape(-1))).encode()


def _unpack(width: int, raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(raw, f"<i{width}").astype(np.int64) if width else np.array([int(v) for v in raw.split(b",")], object)
    return flat.reshape(n, -1)


class Heaps:
    """The heap of each (part position, entry) of a block: its parts by key, the smallest first.

    A key is the part's lower bound on the distance to any other entry minus its upper bound on that to its own, plus the
    drift that its entry had when the part came in, so one look at the top says whether any part of the entry can have lost
    its slack. A heap is a list of ascending runs, one for each round that brought parts; the top of a run is its first key,
    and what drift has passed is popped from the runs' fronts at once.
    """

    def __init__(self, slots: int):
        self.runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(slots)]

    def pop(self, slot: int, drift: float) -> np.ndarray:
        """Takes out and returns the parts whose key is not above ``drift``; rounding of distances counts against them."""
        bound, out, rest = drift + 1e-6 + 1e-12 * abs(drift), [], []
        for keys, items in self.runs[slot]:
            at = int(np.searchsorted(keys, bound, "right"))
            if at:
                out.append(items[:at])
            if at < len(keys):
                rest.append((keys[at:], items[at:]))
        self.runs[slot] = rest
        return np.concatenate(out) if out else np.array([], np.uint16)

    def push(self, slot: int, keys: np.ndarray, items: np.ndarray) -> None:
        """Adds parts by ascending key."""
        self.runs[slot].append((keys, items))

    def dump(self) -> tuple[bytes, bytes, bytes]:
        runs = [(slot, k, i) for slot, own in enumerate(self.runs) for k, i in own]
        joined = lambda parts: b"".join(p.tobytes() for p in parts)
        return np.array([(s, len(k)) for s, k, _ in runs], "<i4").tobytes(), joined(k for _, k, _ in runs), joined(i for _, _, i in runs)

    @classmethod
    def load(cls, slots: int, runs: bytes, keys: bytes, items: bytes) -> Heaps:
        out, at = cls(slots), 0
        k, i = np.frombuffer(keys, "<f4"), np.frombuffer(items, "<u2")
        for slot, n in np.frombuffer(runs, "<i4").reshape(-1, 2).tolist():
            out.runs[slot].append((k[at:at + n], i[at:at + n]))
            at += n
        return out


def reassign(x: np.ndarray, codes: np.ndarray | None, heaps: Heaps, books: Codebooks, parts: int, entries: int):
    """Pops what drift may have moved, rescans it exactly and pushes it again. Returns the codes [parts, n], how many parts
    were rescanned, and [parts, entries, width + 1] changes of sums and counts, as Python integers where int64 is too small."""
    n, width = len(x), x.shape[1] // parts
    fresh = codes is None
    codes = np.zeros((parts, n), np.uint8) if fresh else codes.copy()
    kind = object if x.dtype == object or n * int(abs(x).max() if x.size else 0) >= 1 << 62 else np.int64
    delta, popped = np.zeros((parts, entries, width + 1), kind), 0
    for p in range(parts):
        mine, drift = x[:, p * width:(p + 1) * width], books.drift[p]
        found = np.arange(n, dtype=np.uint16) if fresh else np.concatenate([heaps.pop(p * entries + e, drift[e]) for e in range(entries)])
        if not len(found):
            continue
        popped += len(found)
        square = distances(mine[found], _whole(books.entries[p]))
        new = np.array([min(range(len(r)), key=r.__getitem__) for r in square]) if square.dtype == object else square.argmin(1)
        if square.dtype == object:  # beyond exact floats there is no slack to trust: such parts are rescanned in each round
            key = np.full(len(found), -np.inf)
        elif square.shape[1] > 1:
            two = np.sqrt(np.maximum(np.partition(square, 1, axis=1)[:, :2], 0))
            key = two[:, 1] - two[:, 0] + drift[new]
        else:
            key = np.full(len(found), np.inf)
        key = np.nextafter(key.astype("<f4"), np.float32(-np.inf))
        order = np.lexsort((key, new))
        ends = np.searchsorted(new[order], np.arange(entries + 1))
        for e in range(entries):
            if ends[e] < ends[e + 1]:
                own = order[ends[e]:ends[e + 1]]
                heaps.push(p * entries + e, key[own], found[own])
        old = codes[p][found]
        moved = np.ones(len(found), bool) if fresh else old != new
        rows = np.concatenate([mine[found[moved]].astype(kind), np.ones((int(moved.sum()), 1), kind)], axis=1)
        np.add.at(delta[p], new[moved], rows)
        if not fresh:
            np.subtract.at(delta[p], old[moved], rows)
        codes[p][found] = new
    return codes, popped, delta


def _digits(delta: np.ndarray) -> list[int]:
    """Whole numbers where they are small, else digits, those of all numbers of one place after those of the place before."""
    flat = delta.reshape(-1)
    if delta.dtype != object:
        return flat.tolist()
    out = []
    while any(flat):
        out += [int(v) & ((1 << DIGIT) - 1) for v in flat] if any(abs(int(v)) >> DIGIT for v in flat) else [int(v) for v in flat]
        flat = [int(v) >> DIGIT if any(abs(int(w)) >> DIGIT for w in flat) else 0 for v in flat]
    return out


def _state(key: T.DataType, label: T.DataType) -> T.StructType:
    """A block of vectors: its rows, integers, heaps, codes, and what its last round changed."""
    s = T.StructType().add("keys", T.ArrayType(key)).add("labels", T.ArrayType(label)).add("width", T.IntegerType()).add("x", T.BinaryType())
    for name in ("runs", "slack", "items", "codes"):
        s = s.add(name, T.BinaryType())
    return s.add("delta", T.ArrayType(T.LongType())).add("popped", T.LongType())


def _row(x, codes, heaps, popped, delta) -> dict:
    runs, slack, items = heaps.dump()
    return {"runs": runs, "slack": slack, "items": items, "codes": codes.tobytes(), "delta": _digits(delta), "popped": popped}


_OWN = {"width": pa.int32(), "x": pa.binary(), "runs": pa.binary(), "slack": pa.binary(), "items": pa.binary(), "codes": pa.binary(), "delta": pa.list_(pa.int64()), "popped": pa.int64()}


def _first(books: Codebooks, length: int, parts: int, entries: int, scale: int):
    """Batches (key, label, vector) -> blocks after the first assignment."""

    def block(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        flat = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, length)
        x = integers(np.pad(flat, ((0, 0), (0, -length % parts))), scale)
        heaps = Heaps(parts * entries)
        codes, popped, delta = reassign(x, None, heaps, books, parts, entries)
        width, raw = _pack(x)
        row = {"width": width, "x": raw} | _row(x, codes, heaps, popped, delta)
        whole = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.combine_chunks()) for c in table.columns[:2]]
        return pa.RecordBatch.from_arrays(whole + [pa.array([row[k]], t) for k, t in _OWN.items()], names=["keys", "labels", *_OWN])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                batch, n = batch.slice(part.num_rows), n + part.num_rows
                held.append(part)
                if n == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _opened(batch: pa.RecordBatch, i: int, parts: int, entries: int):
    at = {k: batch.column(k)[i] for k in ("width", "x", "runs", "slack", "items", "codes")}
    n = len(batch.column("keys")[i])
    x = _unpack(at["width"].as_py(), at["x"].as_py(), n)
    heaps = Heaps.load(parts * entries, *(at[k].as_py() for k in ("runs", "slack", "items")))
    return x, np.frombuffer(at["codes"].as_py(), np.uint8).reshape(parts, n), heaps


def _again(books: Codebooks, parts: int, entries: int):
    """Blocks -> the same blocks after another assignment."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x, codes, heaps = _opened(batch, i, parts, entries)
                rows.append(_row(x, *(lambda c, p, d, h=heaps: (c, h, p, d))(*reassign(x, codes, heaps, books, parts, entries))))
            new = {k: pa.array([r[k] for r in rows], t) for k, t in _OWN.items() if k not in ("width", "x")}
            yield pa.RecordBatch.from_arrays([new.get(k, batch.column(k)) for k in batch.schema.names], names=batch.schema.names)

    return run


def _coded(books: Codebooks, parts: int, entries: int):
    """Blocks -> (key, label, code, error) after the last assignment."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, codes, heaps = _opened(batch, i, parts, entries)
                codes = reassign(x, codes, heaps, books, parts, entries)[0]
                own = np.concatenate([_whole(books.entries[p])[codes[p]] for p in range(parts)], axis=1)
                wide = x.dtype == object or x.shape[1] * (2 * max(int(abs(a).max()) if a.size else 0 for a in (x, own))) ** 2 >= 1 << 62
                gap = x.astype(object) - own if wide else x - own
                error = [int(e) for e in (gap * gap).sum(1)] if gap.shape[1] else [0] * len(x)
                code = [row.tobytes().hex() for row in np.ascontiguousarray(codes.T)]
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, batch.column("labels")[i].values, pa.array(code, pa.string()), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], names=["key", "label", "code", "error"])

    return run


def _moved(state: DataFrame, sums: np.ndarray) -> np.ndarray:
    """``sums`` plus the changes of all blocks."""
    new = sums.reshape(-1).copy()
    for r in state.select(F.posexplode("delta")).groupBy("pos").agg(F.sum("col").alias("v")).where("v <> 0").collect():
        new[r.pos % len(new)] += r.v << DIGIT * (r.pos // len(new))
    return new.reshape(sums.shape)


def _updated(books: Codebooks, sums: np.ndarray) -> Codebooks:
    """Each used entry becomes the floor of its parts' mean; drift grows by how far it and the farthest other one moved."""
    entries = [[[int(v) // int(s[-1]) for v in s[:-1]] if s[-1] else e for e, s in zip(book, own)] for book, own in zip(books.entries, sums)]
    drift = books.drift.copy()
    for p, (old, new) in enumerate(zip(books.entries, entries)):
        try:
            moved = np.array([float(sum((a - b) ** 2 for a, b in zip(o, e))) for o, e in zip(old, new)]) ** 0.5
        except OverflowError:
            moved = np.full(len(old), np.inf)
        for e in range(len(moved)):
            drift[p, e] += moved[e] + max((m for j, m in enumerate(moved) if j != e), default=0.0)
    return Codebooks(entries, drift)


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label", trace: list | None = None) -> tuple[DataFrame, Codebooks]:
    """(key, label, code, error) of each vector, and the codebooks.

    A component becomes floor(scale * component), a vector is cut into equal consecutive parts. Each position's codebook
    starts as that part of the vectors with the smallest keys; each round assigns every part to its nearest entry (ties to
    the lower index) and moves each used entry to the floor of its parts' mean; then parts are assigned again. ``code`` has
    two hex digits a part, ``error`` is the sum of the parts' squared distances.

    A block of vectors keeps its parts in heaps by entry, keyed by slack; a round pops and rescans only those parts whose slack
    the entries' drift has used up, and passes on what sums and counts changed. So a round reads and writes blocks in place,
    without a shuffle, and the driver sees a number for each component of a codebook. Blocks are tables in the shared folder;
    the one of the round before is deleted when the next is written. ``trace`` gets how many parts each round rescanned.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do those of another length than most
    (ties to the shorter). Lengths that ``parts`` does not divide are filled up with zeros, which change no distance. Rows
    with equal keys start codebooks by their components, null keys come last; fewer vectors than ``entries`` give as many
    entries. Components of any size are compared exactly; an error beyond a long is null. Repeated rows give repeated rows,
    labels may be null, other columns are ignored; an empty table gives an empty result and empty codebooks.
    """
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null").where(~odd)
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), Codebooks([[] for _ in range(parts)], np.zeros((parts, 0)))
    length = length[0]
    rows = rows.where(F.size("vector") == length)
    first = rows.orderBy(F.col("key").isNull(), "key", "vector").limit(entries).collect()
    start = integers(np.pad(np.array([r.vector for r in first], float).reshape(len(first), length), ((0, 0), (0, -length % parts))), scale)
    each = start.shape[1] // parts
    books = Codebooks([[[int(v) for v in r[p * each:(p + 1) * each]] for r in start] for p in range(parts)], np.zeros((parts, len(first))))
    schema, sums = _state(rows.schema["key"].dataType, rows.schema["label"].dataType), np.zeros((parts, len(first), each + 1), object)
    path = None
    for k in range(rounds):
        step = _again(books, parts, len(first)) if k else _first(books, length, parts, len(first), scale)
        state, new = park_at((state if k else rows).mapInArrow(step, schema))
        if path:
            delete(df.sparkSession, path)
        path, sums = new, _moved(state, sums)
        if trace is not None:
            trace.append(state.agg(F.sum("popped")).first()[0])
        books = _updated(books, sums)
    if not rounds:
        state, path = park_at(rows.mapInArrow(_first(books, length, parts, len(first), scale), schema))
    out = T.StructType().add("key", schema["keys"].dataType.elementType).add("label", schema["labels"].dataType.elementType).add("code", T.StringType()).add("error", T.LongType())
    coded = cut(state.mapInArrow(_coded(books, parts, len(first)), out))
    delete(df.sparkSession, path)
    books.entries = [[e[:max(0, min(each, length - p * each))] for e in book] for p, book in enumerate(books.entries)]
    return coded, books


def with_label_errors(coded: DataFrame, salts: int = 32) -> DataFrame:
    """``coded`` with ``label_error``: the errors of rows with an equal label, nulls together, summed; null where one of them
    is null or the sum is beyond a long. A label may hold any share of the rows: sums are made before they are dealt, and
    meet the rows of a label in ``salts`` parts."""
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.when(F.count_if(F.col("error").isNull()) == 0, whole).try_cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = coded.withColumn("part", F.pmod(F.xxhash64("key", "code", "error"), F.lit(salts)).cast("int"))
    return dealt.join(sums, dealt["label"].eqNullSafe(sums["of"]) & (dealt["part"] == sums["salt"])).drop("of", "salt", "part")
