"""Divergence of sources in their use of terms: pairs by tiles of group blocks over chunks of the vocabulary, and top terms."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import broadcast_within, cut, texts

#: Groups of a block, terms of a chunk on average, and chunks that one task goes through.
GROUPS, CHUNK, SPAN = 16, 1 << 14, 64
#: Terms that a partition counts before it hands its counts on.
HELD = 1 << 18
#: A term in UTF-8 whose A-Z are lower-cased: a run of ASCII letters and characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A share is counted in billionths; the product is cut in two so that longs hold it for up to 2.8e14 occurrences.
HIGH, LOW = 31_250, 32_000


def share(count, total):
    """1 + floor(1e9 * count / total) for columns or arrays of longs."""
    if isinstance(count, Column):
        div = lambda a, b: F.call_function("div", a, b)
        high = count * F.lit(HIGH)
        return F.lit(1) + div(high, total) * F.lit(LOW) + div(high % total * F.lit(LOW), total)
    high = count * HIGH
    return 1 + high // total * LOW + high % total * LOW // total


def _counted(batches):
    """Batches (lang, source, text) -> how often and in how many documents each (lang, source) uses each term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    waiting = 0

    def out():
        for (lang, source), (uses, docs) in held.items():
            n = len(uses)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(uses), pa.binary()), pa.array(list(uses.values()), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())], names=["lang", "source", "term", "uses", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = (batch.column(k).to_pylist() for k in (0, 1))
        for lang, source, text in zip(langs, sources, batch.column(2)):
            found = TERM.findall(text.as_buffer().to_pybytes().lower())
            uses, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(uses)
            uses.update(found)
            docs.update(set(found))
            waiting += len(uses) - before
            if waiting > HELD:
                yield from out()
                waiting = 0
    yield from out()


def term_counts(docs: DataFrame, least: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, uses, total) of the terms in at least ``least`` documents of the language, cut; ``total`` are its
    uses in the whole language. Counts are summed inside partitions before they are dealt by language and term."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = texts(docs).select(name(lang).alias("lang"), name(source).alias("source"), name(text).cast("binary").alias("text"))
    raw = rows.mapInArrow(_counted, "lang string, source string, term binary, uses long, docs long").withColumn("term", F.col("term").cast("string"))
    each = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = each.withColumn("total", F.sum("uses").over(term)).withColumn("docs", F.sum("docs").over(term)).where(F.col("docs") >= least)
    return cut(kept.select("lang", "source", "term", "uses", "total"))


def _tiles(batches):
    """Batches (lang, i, j, span, chunk, source, block, size, terms, width, at, uses), sorted by the first five -> sums (lang, a, b,
    value) of each task. The rows of chunk -1 name the groups of both blocks, with their sums and the terms of the span; the
    others hold a group's packed counts in a chunk."""

    def dense(rows, index, width):
        m = np.zeros((len(index), width), np.int64)
        for r in rows:
            if r["source"] in index:
                m[index[r["source"]], r["at"]] = r["uses"]
        return m

    def gap(p, q):
        return (p - q) ** 2 // (p + q)

    class Task:
        def __init__(self):
            self.names, self.rows, self.chunk, self.seen = [{}, {}], [], None, 0
            self.sums = None

        def add(self, r):
            if r["chunk"] < 0:
                self.terms, self.i, self.j = r["terms"], r["i"], r["j"]
                self.names[r["block"] != r["i"]][r["source"]] = r["size"]
                return
            if r["chunk"] != self.chunk:
                self.close()
                self.chunk = r["chunk"]
            self.rows.append(r)

        def open(self):
            if self.i == self.j:
                self.names[1] = self.names[0]
            self.index = [{s: k for k, s in enumerate(n)} for n in self.names]
            self.sizes = [np.array(list(n.values()), np.int64)[:, None] for n in self.names]
            self.sums = np.zeros(tuple(map(len, self.names)), np.int64)

        def close(self):
            if self.sums is None:
                self.open()
            if self.rows:
                width = self.rows[0]["width"]
                p, q = (share(dense(self.rows, index, width) + 2, np.maximum(size, 1)) for index, size in zip(self.index, self.sizes))
                for a in range(len(p)):
                    self.sums[a] += gap(p[a], q).sum(axis=1)
                self.seen += width
                self.rows = []

        def done(self):
            self.close()
            if self.terms > self.seen:  # chunks in which none of these groups has a term
                p, q = (share(np.full_like(size, 2), np.maximum(size, 1)) for size in self.sizes)
                self.sums += (self.terms - self.seen) * gap(p, q.T)
            a, b = (list(n) for n in self.names)
            pairs = [(a[x], b[y], int(self.sums[x, y])) for x in range(len(a)) for y in range(x + 1 if self.i == self.j else 0, len(b))]
            return [list(c) for c in zip(*pairs)] if pairs else [[], [], []]

    def finished(key, task):
        a, b, v = task.done()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(v), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.int64())], names=["lang", "a", "b", "value"])

    def run(batches):
        key, task = None, None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n not in ("at", "uses")}
            for k in range(batch.num_rows):
                row = {n: c[k] for n, c in columns.items()}
                now = (row["lang"], row["i"], row["j"], row["span"])
                if now != key:
                    if task:
                        yield finished(key, task)
                    key, task = now, Task()
                if row["chunk"] >= 0:
                    row |= {n: batch.column(n)[k].values.to_numpy() for n in ("at", "uses")}
                task.add(row)
        if task:
            yield finished(key, task)

    return run(batches)


def pair_divergence(kept: DataFrame, groups: DataFrame, block: int = GROUPS, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(lang, a, b, value) for each two groups a < b of a language: the divergence of their shares summed over all kept terms.

    A language's vocabulary falls into chunks by hash, its groups into blocks. A group's counts in a chunk are packed into one
    row and sent to each tile of group block by group block that the group has a part in; a tile works through the chunks of a
    span in turn and holds one at a time, as dense counts. Tiles of different spans are tasks of their own and are summed per
    pair, so a task is bounded by block, chunk and span. ``groups`` (lang, source, size, terms) are all groups with size = N + 2 V.
    """
    order = Window.partitionBy("lang").orderBy("source")
    placed = groups.withColumn("block", F.floor((F.row_number().over(order) - 1) / block).cast("int"))
    chunks = lambda terms: F.greatest(F.ceil(terms / chunk), F.lit(1)).cast("int")
    blocks = placed.groupBy("lang").agg(F.max("block").alias("last"), F.first("terms").alias("terms"))
    placed = cut(placed.join(blocks.select("lang", "last"), "lang"))
    near = broadcast_within(placed)

    parts = kept.join(F.broadcast(cut(blocks.select("lang", chunks(F.col("terms")).alias("chunks")))) if blocks.count() < 10_000 else blocks.select("lang", chunks(F.col("terms")).alias("chunks")), "lang")
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).repartition("lang", "chunk")
    whole = Window.partitionBy("lang", "chunk")
    parts = parts.withColumn("at", F.dense_rank().over(whole.orderBy("term")) - 1)
    packed = parts.withColumn("width", F.max("at").over(whole) + 1).groupBy("lang", "chunk", "source", "width").agg(F.collect_list(F.struct("at", "uses")).alias("c"))
    packed = cut(packed.select("lang", "chunk", "source", "width", F.col("c.at").alias("at"), F.col("c.uses").alias("uses")))
    spans = packed.select("lang", "chunk", "width").distinct().groupBy("lang", F.floor(F.col("chunk") / span).cast("int").alias("span")).agg(F.sum("width").alias("terms"))
    every = blocks.select("lang", F.explode(F.sequence(F.lit(0), F.floor((chunks(F.col("terms")) - 1) / span).cast("int"))).alias("span")).join(spans, ["lang", "span"], "left").select("lang", "span", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))

    tile = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    names = ["lang", "i", "j", "span", "chunk", "source", "block", "size", "terms", "width", "at", "uses"]
    heads = placed.drop("terms").join(every, "lang").select("lang", "source", "block", "size", "span", "terms", F.lit(-1).alias("chunk"), F.lit(0).alias("width"), F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("uses"), tile)
    counts = packed.join(near.select("lang", "source", "block", "size", "last"), ["lang", "source"]).select("lang", "source", "block", "size", F.floor(F.col("chunk") / span).cast("int").alias("span"), F.lit(0).cast("long").alias("terms"), "chunk", "width", "at", "uses", tile)
    rows = heads.unionByName(counts).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*names)
    sums = rows.repartition("lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "span", "chunk", "source").mapInArrow(_tiles, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's use of terms is from each other source's of its language
    (part ``pair``), and the terms that it uses most beyond the language (part ``term``, ``top`` of them).

    A group's share of a kept term is p = 1 + floor(1e9 * (count + 2) / (N + 2 V)), N being its occurrences of the language's V
    kept terms; two shares differ by floor((p - q)^2 / (p + q)). All arithmetic is exact for up to 2.8e14 occurrences.

    Null text, lang and source count as ''. A group whose texts hold no kept term, or no term at all, stands in all pairs of
    its language; a language without kept terms gives pairs of value 0; one of a single source gives no pairs. Repeated rows
    count as often as they stand there, ties are ranked by item, other columns are ignored, an empty table gives an empty result.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = term_counts(docs, least)
    own = kept.groupBy("lang", "source").agg(F.sum("uses").alias("n"))
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole"))
    groups = docs.select(name("lang"), name("source")).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).alias("size"), F.coalesce("terms", F.lit(0)).alias("terms"), (F.col("whole") + 2 * F.col("terms")).alias("whole")))

    half = cut(pair_divergence(kept, groups.select("lang", "source", "size", "terms")))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    order = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = half.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(order()))

    sized = kept.join(broadcast_within(groups).select("lang", "source", "size", "whole"), ["lang", "source"])
    shares = sized.select("lang", "source", F.col("term").alias("item"), share(F.col("uses") + 2, F.col("size")).alias("p"), share(F.col("total") + 2, F.col("whole")).alias("q")).where("p > q")
    terms = shares.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value")).withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
