"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import cut

#: Rows that centroids are fitted on, probes that the candidate budget is measured with, and their recall at that budget.
SAMPLE, PROBES, RECALL = 20_000, 256, 0.985
#: Rows of a cell, and queries, that one task compares.
BLOCK = 4096
#: Rows that a pair of centroids holds on average.
CELL = 200


def usable(vector: str) -> Column:
    """Whether a vector is not null, not zero, and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very small and large components in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """k-means with seeded k-means++ starts; empty clusters keep their centroid."""
    draw = np.random.default_rng(seed)
    c = [x[draw.integers(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    for _ in range(k - 1):
        c.append(x[draw.choice(len(x), p=far / far.sum())] if far.sum() > 0 else c[0])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        for j in range(k):
            if (mine := near == j).any():
                c[j] = x[mine].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


class Index:
    """Centroids of two vector halves, and how many rows each pair of them holds."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.k = min(k, len(sample))
        self.first, self.second = centroids(sample[:, :self.half], self.k), centroids(sample[:, self.half:], self.k, seed=1)
        self.held = np.zeros(self.k * self.k, np.int64)
        self.budget = 0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return distances(x[:, :self.half], self.first).argmin(1) * self.k + distances(x[:, self.half:], self.second).argmin(1)

    def walk(self, q: np.ndarray, most: int) -> list[int]:
        """Cells by ascending sum of the halves' distances, until they hold ``most`` rows; empty cells are passed over.

        The multi-sequence algorithm: a heap holds the pairs of ranks next to those taken; a pair enters when both pairs
        before it, in either half, have been taken.
        """
        a, b = distances(q[None, :self.half], self.first)[0], distances(q[None, self.half:], self.second)[0]
        i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i_of].tolist(), b[j_of].tolist()
        heap, taken, out, got = [(a[0] + b[0], 0, 0)], set(), [], 0
        while heap and got < most:
            _, i, j = heapq.heappop(heap)
            taken.add((i, j))
            cell = int(i_of[i] * self.k + j_of[j])
            if self.held[cell]:
                out.append(cell)
                got += int(self.held[cell])
            if i + 1 < self.k and (not j or (i + 1, j - 1) in taken):
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < self.k and (not i or (i - 1, j + 1) in taken):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return out

    def ranked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All cells with rows by ascending sum of the halves' distances, and how many rows they hold up to each."""
        a, b = distances(q[None, :self.half], self.first)[0], distances(q[None, self.half:], self.second)[0]
        cells = np.argsort((a[:, None] + b).reshape(-1), kind="stable")
        cells = cells[self.held[cells] > 0]
        return cells, np.cumsum(self.held[cells])

    def reach(self, q: np.ndarray) -> tuple[list[int], list[int]]:
        """The cells within the budget, in two parts: the first hold sqrt(budget * CELL) rows, the rest are behind them.

        What beats the neighbours found in the first part is then about as little as that part itself."""
        cells = self.walk(q, self.budget)
        first = int(np.searchsorted(np.cumsum(self.held[cells]), np.sqrt(self.budget * CELL))) + 1
        return cells[:first], cells[first:]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, largest first, ties by id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _true_cells(classes: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(probe, cell) of the k nearest other classes of each probe, by comparing the probes with every row in blocks."""

    def compare(batches):
        for batch in batches:
            own, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            s = probes @ unit(batch.column(2).to_pylist()).T
            rows = [(i, int(own[j]), int(cell[j]), float(s[i, j])) for i in range(len(probes)) for j in best(np.where(own == ids[i], -2.0, s[i]), own, k) if own[j] != ids[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["probe", "cid", "cell", "score"])

    near = classes.select("cid", "cell", "vector").mapInArrow(compare, "probe long, cid long, cell long, score double")
    first = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cid"))
    return [(r.probe, r.cell) for r in near.withColumn("r", first).where(F.col("r") <= k).select("probe", "cell").collect()]


def build(vectors: DataFrame, k: int, recall: float = RECALL) -> tuple[DataFrame, Index] | None:
    """(cut table of classes (cid, vector, ids, cell), index) of a table of distinct (vec_id, vector), or None if it is empty.

    Equal vectors make one class, of which the k + 1 smallest vec_ids are kept: no query needs more of them. Centroids are
    fitted on a sample of at most about SAMPLE classes by hash; every class is put into its cell. Then the rows that a
    query has to look at are measured: PROBES classes are compared with all rows, and the budget is what ``recall`` of
    their nearest neighbours need, k + 1 rows at least; all rows if ``recall`` is 1 or more.
    """
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.withColumn("r", first).where(F.col("r") <= k + 1)
    classes = cut(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    n = classes.count()
    if not n:
        return None
    order = F.pmod(F.xxhash64("cid", F.lit(8)), F.lit(1 << 30))
    sample = classes.where(order < min(1.0, SAMPLE / n) * (1 << 30)).select("cid", "vector").collect() or classes.limit(SAMPLE).select("cid", "vector").collect()
    sample.sort(key=lambda r: r.cid)
    x = unit([r.vector for r in sample])
    index = Index(x, int(np.clip(round(np.sqrt(n / CELL)), 2, 256)))

    @F.pandas_udf("long")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(index.cells(unit(v))) if len(v) else pd.Series([], dtype="int64")

    classes = cut(classes.withColumn("cell", cell("vector")))
    for c, held in classes.groupBy("cell").count().collect():  # at most a row for each pair of centroids
        index.held[c] = held
    at = np.random.default_rng(2).permutation(len(sample))[:PROBES]
    ids = np.array([sample[i].cid for i in at], np.int64)
    if recall >= 1:
        index.budget = n
        return classes, index
    upto = [dict(zip(cells.tolist(), held.tolist())) for cells, held in map(index.ranked, x[at])]
    need = [upto[p][c] for p, c in _true_cells(classes, x[at], ids, k)]
    index.budget = max(k + 1, int(np.quantile(need, recall, method="higher"))) if need else n
    return classes, index


def _compare(k: int):
    """Joins queries (qid, asked, least) with the rows of a cell: the k + 1 best of each query that reach ``least``."""
    schema = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            q, x = unit(left.column("asked").to_pylist()), unit(right.column("vector").to_pylist())
            qid, least, cid, ids = left.column("qid").to_pylist(), left.column("least").to_pylist(), right.column("cid").to_numpy(), right.column("ids").to_pylist()
            for i, s in enumerate(q @ x.T):
                if s.max() >= least[i]:
                    rows += [(qid[i], int(cid[j]), ids[j], float(s[j])) for j in best(s, cid, k + 1) if s[j] >= least[i]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    return compare


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows, by cosine, of each row of which the key is divisible by
    ``every``, nearest first and ties by smaller vec_id; all others if they are fewer.

    A query walks the pairs of centroids until their cells hold the index's budget of rows and meets these cells' rows,
    which are compared in double precision. The first cells give a bound, and of the cells behind them only rows that
    reach it leave their task. A cell's rows and the queries that reach it are split into blocks that meet pairwise, so no
    task outgrows BLOCK rows of either, and only cells that many queries reach are copied; equal vectors are searched once.
    With a ``recall`` of 1 every query meets all cells, and the answer is exact.

    Null keys, null and zero vectors, vectors with null or non-finite components, and vectors of another length than most
    (cosine has no value for these) take no part; repeated rows count once; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], shape)
    rows = cut(rows.where(F.size("vector") == sizes[0].n).groupBy("vec_id", "vector").agg(F.lit(1).alias("one")).drop("one"))
    classes, index = build(rows, k, recall)
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = cut(asked.join(classes.select("vector", "cid"), "vector").select("vec_id", "cid"))
    wanted = cut(classes.join(queries.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), "vector"))
    parts = np.maximum(1, -(-index.held // BLOCK))

    def reached(asking: DataFrame, part: int) -> DataFrame:
        """(qid, least, cell) of (qid, vector, least), for the first cells (0) or those behind (1)."""
        schema = pa.schema([("qid", pa.int64()), ("least", pa.float64()), ("cells", pa.list_(pa.int64()))])

        def walk(batches):
            for batch in batches:
                out = [(qid, least, index.reach(unit([v])[0])[part]) for qid, v, least in zip(*(c.to_pylist() for c in batch.columns))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

        lists = asking.select("qid", "vector", "least").mapInArrow(walk, "qid long, least double, cells array<long>")
        return cut(lists.select("qid", "least", F.explode("cells").alias("cell")))

    def meet(asking: DataFrame, part: int) -> DataFrame:
        """Each query with the rows of its cells, in blocks."""
        asks = reached(asking, part)
        sides = {r.cell: -(-r.n // BLOCK) for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most a row for each pair of centroids
        blocks = F.broadcast(spark.createDataFrame([(c, int(parts[c]), int(n)) for c, n in sides.items()], "cell long, parts long, sides long"))
        left = asks.join(blocks, "cell").join(wanted, "qid").select("qid", F.col("vector").alias("asked"), "least", F.col("cell").alias("cell"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.pmod(F.xxhash64("qid"), F.col("sides")).alias("side"))
        right = classes.join(blocks, "cell").select("cid", "ids", "vector", "cell", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"), F.explode(F.expr("sequence(0L, sides - 1)")).alias("side"))
        by = ["cell", "part", "side"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compare(k), "qid long, cid long, ids array<long>, score double")

    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    top = lambda met: cut(met.withColumn("r", first).where(F.col("r") <= k + 1).drop("r"))
    near = top(meet(wanted.withColumn("least", F.lit(-2.0)), 0))
    bound = near.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
    bounded = wanted.join(bound, "qid", "left").select("qid", "vector", F.coalesce("bound", F.lit(-2.0)).alias("least"))
    hits = top(near.union(meet(bounded, 1)))
    found = queries.join(hits, queries["cid"] == hits["qid"]).select(F.col("vec_id").alias("query_id"), F.explode("ids").alias("near"), "score").where("near <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "near"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("near").alias("vec_id"), "score")
