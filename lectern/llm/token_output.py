"""Token-id matrices by best-fit-decreasing packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import encoder
from lectern.storage import texts

ROWS = "sequence_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class Capacities:
    """Open bins by what they can still hold, in a segment tree over the capacities 0 .. most."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.held = [0] * (2 * self.leaves)  # bins under each node
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, bin) of the smallest capacity of at least ``least``."""
        held, at = self.held, least + self.leaves
        while not held[at]:
            # the next subtree to the right: up while this is a right child, then over
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if held[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.held[at] += n
            at >>= 1


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Indices of pieces by bin: longest first, each into the fullest bin that still holds it."""
    open_, bins = Capacities(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if found := open_.take(lengths[i]):
            room, b = found
        else:
            room, b = most, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            open_.put(room - lengths[i], b)
    return bins


def pack_matrix(docs: DataFrame, tokenizer: str, window: int = 2048, end: int | None = 1, pad: int = 0, lane: int = 1 << 20) -> DataFrame:
    """A row (sequence_id, n_tokens, doc_ids, doc_starts, cu_seqlens, input_ids, position_ids) for each sequence.

    ``input_ids`` is a row of the id matrix: ``window`` little-endian unsigned 32-bit ids, padded with ``pad`` behind
    ``n_tokens``. ``cu_seqlens`` are the cumulative lengths of its segments from 0, ``position_ids`` restart at 0 with
    each segment and in the padding, ``doc_starts`` say where in its document each segment begins. Documents over
    ``window`` ids are split into full pieces and a rest, so every id lies in exactly one segment.

    Each partition packs its documents by best fit, decreasing, in stretches of about ``lane`` ids: nothing is shuffled,
    memory is bounded by the stretch and a lost task is repeated alone.

    Null text counts as empty and yields the end id alone (nothing if ``end`` is None); null doc_ids, ties and repeated
    rows are packed like others; an empty table gives an empty result; other columns are ignored.
    """
    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])

    def batches(parts):
        enc, sequence, held = encoder(tokenizer), 0, 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        tail = [] if end is None else [end]

        def flush():
            nonlocal sequence, held, pieces
            rows = []
            for chosen in best_fit([len(p[2]) for p in pieces], window):
                parts_ = [pieces[i] for i in chosen]
                sizes = [len(p[2]) for p in parts_]
                n = sum(sizes)
                ids, at = np.full(window, pad, "<u4"), np.zeros(window, "<u4")
                ids[:n] = np.concatenate([p[2] for p in parts_])
                at[:n] = np.concatenate([np.arange(k) for k in sizes])
                at[n:] = np.arange(window - n)
                rows.append((sequence, n, [p[0] for p in parts_], [p[1] for p in parts_], [0, *np.cumsum(sizes).tolist()], ids.tobytes(), at.tobytes()))
                sequence += 1
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
            pieces, held = [], 0

        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                ids = np.frombuffer(enc.ids(text.as_py()), "<u2" if enc.code == "H" else "<u4").astype("<u4")
                ids = np.concatenate([ids, np.array(tail, "<u4")])
                for start in range(0, len(ids), window):
                    pieces.append((doc, start, ids[start:start + window]))
                    held += len(pieces[-1][2])
                    if held >= lane:
                        yield from flush()
        yield from flush()

    packed = texts(docs).select("doc_id", "text").mapInArrow(batches, ROWS)
    return packed.withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("sequence_id"))


def save(rows: DataFrame, path: str) -> DataFrame:
    """Writes matrix rows as a Parquet table, each task its own file, and returns the table as read from there."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def matrix(rows: list, column: str = "input_ids") -> np.ndarray:
    """[sequence, position] of the ids, or the positions, of rows held here."""
    return np.stack([np.frombuffer(r[column], "<u4") for r in rows]) if rows else np.zeros((0, 0), "<u4")
