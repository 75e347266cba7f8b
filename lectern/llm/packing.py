"""Mixture-controlled packing: every window holds the sources in their target proportions."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import BATCH_BYTES, class_key
from lectern.llm.tokens import encoder
from lectern.storage import broadcast_within, cut, park, texts

PIECES = "doc_id long, cls string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenise(docs: DataFrame, path: str, end: int | None = 1) -> DataFrame:
    """(doc_id, cls, at, n, ids) for (doc_id, cls, text): ids with ``end`` behind, and where they start among the
    partition's tokens of the class. ids are of 2 or 4 bytes, by the size of the vocabulary."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def batches(parts):
        enc, at = encoder(path), {}
        width = 2 if enc.code == "H" else 4
        tail = b"" if end is None else int(end).to_bytes(width, "little")

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for part in parts:
            rows, held = [], 0
            for doc, cls, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                ids = enc.ids(text.as_py()) + tail
                n, start = len(ids) // width, at.get(cls, 0)
                rows.append((doc, cls, start, n, ids))
                at[cls], held = start + n, held + len(ids)
                if held > BATCH_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return texts(docs).select("doc_id", "cls", "text").mapInArrow(batches, "doc_id long, cls string, at long, n long, ids binary")


def phases(totals: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """(class, from, to) of each class's tokens, phase by phase: in a phase the proportions are those of the weights
    among the classes that still have tokens, and it ends where the first of them runs out."""
    done, out = dict.fromkeys(totals, 0), []
    while left := {c: totals[c] - done[c] for c in totals if totals[c] > done[c]}:
        clock = min(n / weights[c] for c, n in left.items())
        step = {c: min(n, max(1, round(clock * weights[c]))) if n / weights[c] > clock else n for c, n in left.items()}
        out.append([(c, done[c], done[c] + n) for c, n in step.items()])
        done = {c: done[c] + step.get(c, 0) for c in totals}
    return out


class _Lane:
    """Deficit round-robin over the queues of one lane."""

    def __init__(self, queues: dict[str, deque], window: int, least: int):
        self.queues, self.window, self.least = queues, window, least
        self.left = {c: sum(x[1] for x in q) for c, q in queues.items()}
        total = sum(self.left.values())
        self.share = {c: n / total for c, n in self.left.items()}
        self.deficit = dict.fromkeys(queues, 0.0)
        self.names = sorted(queues)

    def serve(self, name: str, most: int):
        """The next piece of a queue, of at most ``most`` tokens: (row, tokens of it already gone, length)."""
        head = self.queues[name][0]
        n = min(head[1], most)
        piece = (head[0], head[2], n)
        head[1] -= n
        head[2] += n
        if not head[1]:
            self.queues[name].popleft()
        self.left[name] -= n
        self.deficit[name] -= n
        return piece

    def windows(self):
        """Lists of pieces. Every window adds a queue's share of it to the queue's deficit and serves what the deficit
        covers, whole documents or at least ``least`` tokens; smaller claims are carried. What is then left of the window
        goes to the queues with the largest deficits, which fall below zero and are paid back by later windows."""
        turn, names = 0, self.names
        while total := sum(self.left.values()):
            room, pieces = min(self.window, total), []
            names = [c for c in names if self.left[c]]
            for c in names:
                self.deficit[c] += self.share[c] * self.window
            turn = (turn + 1) % len(names)
            for c in names[turn:] + names[:turn]:
                while room and self.left[c]:
                    claim = min(int(self.deficit[c]), room)
                    if claim <= 0 or claim < self.least and claim < self.queues[c][0][1]:
                        break
                    pieces.append((c, self.serve(c, claim)))
                    room -= pieces[-1][1][2]
            while room:
                c = max((c for c in names if self.left[c]), key=self.deficit.__getitem__)
                pieces.append((c, self.serve(c, room)))
                room -= pieces[-1][1][2]
            yield pieces


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int | None = 1, weights: dict[str, float] | None = None, least: int = 64, lane: int = 1 << 20, source: str = "source") -> DataFrame:
    """Pieces (doc_id, cls, start, length, ids, doc_tokens, sequence_id, offset) of all documents in windows.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers. Every token lies in one piece; pieces of a
    sequence fill it from offset 0 without gaps, and all but the last sequence of a lane are full.

    Each source's tokens form a line: a document's place on it is its place in its input partition plus a running sum over
    partitions. A lane is a stretch of about ``lane`` tokens, cut from every line in proportion, in units of ``least``
    tokens; where the rounding falls is turned by a hash of the source, so small sources spread over the lanes. No lane
    depends on another's rows, a lane's deficits start where the lane before left off (less than a unit), and a source of
    any size is dealt out evenly. Within a lane, deficit round-robin fills one window after the other.

    Target proportions are those of the sources in the table, or ``weights`` by source (``"*"`` for all others, 1 if not
    given) as long as the sources last; tokens per listed source are then read on the driver, one number each.

    Null text counts as empty and yields the end id alone (nothing if ``end`` is None); null doc_ids and repeated rows are
    packed like others; null sources are one source; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cls = class_key(source)
    if weights is not None:
        named = [f"={k}" for k in weights if k != "*"]
        cls = F.when(cls.isin(named), cls).otherwise("*")
    tokens = park(tokenise(docs.select("doc_id", cls.alias("cls"), "text"), tokenizer, end).where("n > 0").withColumn("part", F.spark_partition_id()))
    sums = cut(tokens.groupBy("cls", "part").agg(F.sum("n").alias("n")))
    total = sums.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], PIECES)
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if weights is None:
        lanes = -(-total // lane)
        lines = sums.groupBy("cls").agg(F.sum("n").alias("hi")).select("cls", F.lit(0).cast("long").alias("lo"), "hi", F.lit(0).cast("long").alias("first"), F.lit(lanes).cast("long").alias("lanes"))
    else:
        totals, rows, first = dict(sums.groupBy("cls").agg(F.sum("n")).collect()), [], 0  # at most a row for each weight
        wanted = {c: float(weights.get(c.removeprefix("="), weights.get("*", 1.0))) for c in totals}
        for phase in phases(totals, wanted):
            lanes = -(-sum(hi - lo for _, lo, hi in phase) // lane)
            rows += [(c, lo, hi, first, lanes) for c, lo, hi in phase]
            first += lanes
        lines = spark.createDataFrame(rows, "cls string, lo long, hi long, first long, lanes long")
    lines = cut(lines)
    classes = lines.count()
    turn = F.pmod(F.xxhash64("cls", F.lit(2)), F.col("lanes"))
    bases = cut(bases.join(broadcast_within(lines), "cls").withColumn("units", F.ceil((F.col("hi") - F.col("lo")) / least)).withColumn("turn", turn))
    big = lambda x: f"cast({x} as decimal(19,0))"
    lane_of = lambda j: f"(({big(j)} + 1) * {big('lanes')} - turn - 1) div {big('units')}"
    edge = lambda k: f"{least} * (({big(k)} * {big('units')} + turn) div {big('lanes')})"
    chunks = (
        tokens.join(broadcast_within(bases), ["cls", "part"]).withColumn("p", F.col("base") + F.col("at")).where("p < hi and p + n > lo")
        .withColumn("p0", F.expr("greatest(p, lo) - lo")).withColumn("p1", F.expr("least(p + n, hi) - lo"))
        .withColumn("j0", F.expr(f"p0 div {least}")).withColumn("j1", F.expr(f"(p1 - 1) div {least}")).withColumn("few", F.expr("units < lanes"))
        .withColumn("s", F.explode(F.expr(f"sequence(if(few, j0, {lane_of('j0')}), if(few, j1, {lane_of('j1')}))")))
        .withColumn("k", F.expr(f"if(few, {lane_of('s')}, s)"))
        .withColumn("from", F.expr(f"greatest(p0, if(few, s * {least}, {edge('s')}))"))
        .withColumn("to", F.expr(f"least(p1, if(few, (s + 1) * {least}, {edge('s + 1')}))"))
        .where("to > from").withColumn("start", F.expr("from + lo - p")).withColumn("width", F.expr("cast(octet_length(ids) div n as int)"))
        .select((F.col("first") + F.col("k")).alias("lane"), "doc_id", "cls", F.expr("from + lo").alias("at"), "start", F.expr("to - from").alias("length"), F.col("n").alias("doc_tokens"),
                F.expr("substring(ids, cast(start * width + 1 as int), cast((to - from) * width as int))").alias("ids"), "width")
    )
    stride = (lane + 2 * classes * least) // window + 2  # a lane holds a share of each line, rounded to units of ``least``
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(table: pa.Table) -> pa.Table:
        x = table.sort_by([("cls", "ascending"), ("at", "ascending")])
        number, names, doc, start, size, whole, ids, width = (x.column(c).to_pylist() for c in ("lane", "cls", "doc_id", "start", "length", "doc_tokens", "ids", "width"))
        queues: dict[str, deque] = {}
        for row, (c, n) in enumerate(zip(names, size)):
            queues.setdefault(c, deque()).append([row, n, 0])
        wide = [np.frombuffer(b, f"<u{w}").astype("<u4") for b, w in zip(ids, width)]
        out = []
        sequence = number[0] * stride
        for pieces in _Lane(queues, window, least).windows():
            offset = 0
            for c, (row, gone, n) in pieces:
                out.append((doc[row], c, start[row] + gone, n, wide[row][gone:gone + n].tobytes(), whole[row], sequence, offset))
                offset += n
            sequence += 1
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return chunks.groupBy("lane").applyInArrow(fill, PIECES)
