"""Votes on regions, their conflicts and adjudication, and samples for studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import collapsed, portable_hash
from lectern.storage import cut

REGION = ["page", "region"]

# --- Votes: (page, region, voter, text, state), one row for each voter and region


def region_status(votes: DataFrame, voters: list[str]) -> DataFrame:
    """(page, region, status, agreed): accepted for the time being if every voter is there, none failed and all say the
    same but for white space; else a conflict."""
    own = votes.where(F.col("voter").isin(voters))
    said = collapsed(F.col("text"))
    sums = own.groupBy(*REGION).agg(F.countDistinct("voter").alias("v"), F.min((F.col("state") == "ok").cast("int")).alias("ok"), F.min(said).alias("lo"), F.max(said).alias("hi"))
    good = (F.col("v") == len(voters)) & (F.col("ok") == 1) & (F.col("lo") == F.col("hi"))
    return sums.select(*REGION, F.when(good, "provisional_accept").otherwise("conflict").alias("status"), F.when(good, F.col("lo")).otherwise("").alias("agreed"))


def triage(status: DataFrame) -> DataFrame:
    """(page, provisional_accept, conflict, regions)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.groupBy("page").agg(n("provisional_accept"), n("conflict"), F.count("*").alias("regions"))


def letters(n: int) -> list[str]:
    """The first ``n`` labels: A to Z, then AA, AB and so on."""
    def label(k: int) -> str:
        return (label(k // 26 - 1) if k >= 26 else "") + chr(ord("A") + k % 26)

    return [label(k) for k in range(n)]


def labelled(pages: DataFrame, voters: list[str], seed: str) -> DataFrame:
    """(page, label, voter): a label of letters for each voter, in an order that differs from page to page and never between
    reruns. Any number of voters has labels of its own."""
    each = pages.select("page", F.explode(F.array(*[F.lit(v) for v in voters])).alias("voter"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("page").cast("string"), F.col("voter")))
    all_ = each.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "voter"))).alias("v"))
    return all_.select("page", F.posexplode("v").alias("k", "x")).select("page", F.element_at(F.array(*[F.lit(x) for x in letters(len(voters))]), F.col("k") + 1).alias("label"), F.col("x.voter").alias("voter"))


def blind_conflicts(votes: DataFrame, status: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, region, label, text, state): what an adjudicator sees of each conflict: letters, no voters; a voter that
    failed or is missing has no output."""
    open_ = status.where("status = 'conflict'").select(*REGION).join(labels, "page")
    joined = open_.join(votes.select(*REGION, "voter", "text", "state"), [*REGION, "voter"], "left")
    ok = F.coalesce(F.col("state") == "ok", F.lit(False))
    return joined.select(*REGION, "label", F.when(ok, F.col("text")).otherwise("").alias("text"), F.when(ok, "ok").otherwise("no_output").alias("state"))


def open_conflicts(status: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(page, open): conflicts without a resolution, 0 included."""
    done = resolutions.where("revision > 0").select(*REGION)
    left = status.where("status = 'conflict'").join(done, REGION, "left_anti").groupBy("page").agg(F.count("*").alias("open"))
    return status.select("page").distinct().join(left, "page", "left").select("page", F.coalesce("open", F.lit(0)).alias("open"))


def adjudicated(resolutions: DataFrame, given: DataFrame) -> DataFrame:
    """(page, region, text, revision, applied): resolutions after the given ones (page, region, text, revision), each of
    which counts only if it was made on the revision that stands (0 where there is none)."""
    old = resolutions.select(*REGION, F.col("text").alias("_text"), F.col("revision").alias("_rev"), F.lit(True).alias("_old"))
    joined = old.join(given.select(*REGION, "text", "revision", F.lit(True).alias("_new")), REGION, "full")
    fits = F.coalesce(F.col("_new") & (F.coalesce("_rev", F.lit(0)) == F.col("revision")), F.lit(False))
    out = joined.select(*REGION, F.when(fits, F.col("text")).otherwise(F.col("_text")).alias("text"), F.when(fits, F.col("revision") + 1).otherwise(F.col("_rev")).alias("revision"), fits.alias("applied"), F.col("_old"))
    return out.where("applied or _old").drop("_old")


def unblinded(votes: DataFrame, status: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(page, region, status, votes, resolved): all votes by voter, as JSON with sorted names, beside the resolution."""
    said = votes.groupBy(*REGION).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("voter", "text"))))).alias("votes"))
    return status.join(said, REGION).join(resolutions.select(*REGION, F.col("text").alias("resolved")), REGION, "left").select(*REGION, "status", "votes", "resolved")


def submission_conflicts(votes: DataFrame, first: str, second: str) -> DataFrame:
    """(page, region, a, b): regions of two submissions that differ by more than white space; a region that only one has is
    compared with the empty text."""
    side = lambda who, n: votes.where(F.col("voter") == who).select(*REGION, F.col("text").alias(n))
    both = side(first, "a").join(side(second, "b"), REGION, "full").na.fill("", ["a", "b"])
    return both.where(collapsed(F.col("a")) != collapsed(F.col("b")))


def final_texts(status: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(page, region, text): the resolution, else what all agreed on; a conflict without a resolution is an error."""
    joined = status.join(resolutions.select(*REGION, F.col("text").alias("resolved")), REGION, "left")
    agreed = F.when(F.col("status") == "provisional_accept", F.col("agreed")).otherwise(F.raise_error(F.lit("an open conflict")).cast("string"))
    return joined.select(*REGION, F.coalesce("resolved", agreed).alias("text"))


def census_checks(regions: DataFrame, page: str, index: str, order: str) -> DataFrame:
    """(page, dense, permutation): whether indices run from 0 without gaps, and reading orders are these indices in some order."""
    all_ = lambda c: F.array_sort(F.collect_list(F.col(c).cast("long")))
    wanted = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    sums = regions.groupBy(page).agg(F.count("*").alias("n"), all_(index).alias("i"), all_(order).alias("o"))
    return sums.select(page, (F.col("i") == wanted).alias("dense"), (F.col("o") == wanted).alias("permutation"))


# --- Samples


def quota_splits(families: DataFrame, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """(key, split): families in the order of the SHA-256 of seed and key fill the splits' quotas, by name; the rest are
    unassigned. Only as many families as the quotas hold are ever ranked."""
    named = families.select(key).distinct()
    order = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")).cast("binary"), 256)
    first = named.orderBy(order, key).limit(sum(max(0, q) for q in quotas.values()))
    rank, split, upto = F.row_number().over(Window.orderBy(order, key)), F.lit("unassigned"), 0
    edges = []
    for name in sorted(quotas):
        edges.append((name, upto, upto := upto + max(0, quotas[name])))
    ranked = first.select(F.col(key).alias("_key"), (rank - 1).alias("_rank"))
    for name, lo, hi in edges:
        split = F.when((F.col("_rank") >= lo) & (F.col("_rank") < hi), name).otherwise(split)
    return named.join(ranked, F.col(key) == F.col("_key"), "left").select(key, F.when(F.col("_rank").isNull(), "unassigned").otherwise(split).alias("split"))


def family_pages(families: DataFrame, pages: DataFrame, key: str, page: str, k: int, seed: str) -> DataFrame:
    """(key, page, probability, stratum): k pages of each family by hash, with min(1, k / pages); a family without pages gets
    the pages 1 to k, marked as unprocessed."""
    order = portable_hash(F.concat(F.lit(seed), F.col(page).cast("string")))
    counts = pages.groupBy(key).agg(F.count("*").alias("_n"))
    ranked = pages.select(key, F.col(page).cast("long").alias(page), F.row_number().over(Window.partitionBy(key).orderBy(order, page)).alias("_r")).where(F.col("_r") <= k)
    real = ranked.join(counts, key).select(key, page, F.least(F.lit(1.0), k / F.col("_n")).alias("probability"), F.lit("sampled").alias("stratum"))
    bare = families.select(key).distinct().join(counts, key, "left_anti").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias(page), F.lit(1.0).alias("probability"), F.lit("sampled+unprocessed").alias("stratum"))
    return real.union(bare)


def core_pages(books: DataFrame, key: str, pages: str, k: int, seed: str) -> DataFrame:
    """(key, page, probability): k pages by hash of each book's core, which leaves out two at either end from 12 pages on.

    Books are dealt by key before they have pages, and a book's pages are ranked in its own row, so that a task never sorts
    the pages of all its books."""
    parts = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = books.select(key, F.col(pages).cast("long").alias("_n")).where("_n > 0").repartition(parts, key).groupBy(key).agg(F.collect_list("_n").alias("_n"))
    order = lambda page: portable_hash(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), page.cast("string")))
    core = lambda n: F.when(n >= 12, F.sequence(F.lit(3).cast("long"), n - 2)).otherwise(F.sequence(F.lit(1).cast("long"), n))
    placed = lambda n: F.transform(core(n), lambda p: F.struct(order(p).alias("o"), p.alias("page"), F.when(n >= 12, n - 4).otherwise(n).alias("n")))
    ranked = dealt.select(key, F.explode(F.slice(F.sort_array(F.flatten(F.transform("_n", placed))), 1, k)).alias("p"))
    return ranked.select(key, "p.page", F.round(F.least(F.lit(1.0), k / F.col("p.n")), 4).alias("probability"))


def mixed_sample(rows: DataFrame, key: str, suspicious: Column, cap: int, seed: str, mode: str = "mixed") -> DataFrame:
    """(key, suspicious) of at most ``cap`` rows by hash. ``mixed``: half suspicious ones, and what either pool lacks goes to
    the other; ``suspicious``: these first; ``random``: by hash alone; ``all``: by key."""
    order = portable_hash(F.concat(F.lit(seed), F.col(key).cast("string")))
    marked = rows.select(key, F.coalesce(suspicious, F.lit(False)).alias("suspicious"))
    if mode != "mixed":
        first = {"suspicious": [F.desc("suspicious"), order], "random": [order], "all": []}[mode]
        return marked.orderBy(*first, key).limit(cap)
    bad = marked.where("suspicious").orderBy(order, key).limit(cap)
    good = marked.where("not suspicious").orderBy(order, key).limit(cap)
    n, m = bad.count(), good.count()  # at most cap each
    quota = min(n, cap // 2)
    clean = min(m, cap - quota)
    return bad.orderBy(order, key).limit(min(n, cap - clean)).union(good.orderBy(order, key).limit(clean))


def representative_pages(pages: Column) -> Column:
    """The pages at 15, 50 and 85 % of a document, each once."""
    at = lambda x: F.greatest(F.lit(0).cast("long"), F.least(pages - 1, F.floor(x)))
    return F.when(pages > 0, F.array_distinct(F.array(at(pages * 0.15), at(pages / 2), at(pages * 0.85)))).otherwise(F.array().cast("array<long>"))


def capped_strata(rows: DataFrame, cells: list[list[str]], cell: str, key: str, author: str, per_cell: int = 5, per_author: int = 2, seed: str = "s") -> DataFrame:
    """(cell, key, place) of at most ``per_cell`` rows a cell, in the cells' order, with at most ``per_author`` rows of an author
    over all cells. Each entry of ``cells`` is a cell and the cells that fill it where it is short. Rows go by hash; those
    without an author, or with the author ``unknown``, are left out.

    Cells are asked in turn: of the rows not drawn yet, those that stand within what their author has left come first, and
    the first ``per_cell`` of these are what a draw row by row takes. So the driver sees the rows drawn, as many as the
    cells have places, and no row is passed over however many cells and full authors there are.
    """
    order = portable_hash(F.concat_ws(":", F.lit(seed), F.col(cell), F.col(key).cast("string")))
    known = rows.where(F.col(author).isNotNull() & (F.col(author) != "unknown"))
    every = cut(known.select(F.col(cell).alias("from"), F.col(key).alias("key"), F.col(author).alias("author"), order.alias("o")))
    used: dict[str, int] = {}
    out: list[tuple] = []
    for sources in cells:
        place = F.array_position(F.array(*[F.lit(c) for c in sources]), F.col("from"))
        mine = every.withColumn("p", place).where("p > 0")
        if out:
            mine = mine.where(~F.col("key").isin([k for _, k, _ in out]))
        rank = F.row_number().over(Window.partitionBy("author").orderBy("p", "o", "key"))
        mine = mine.withColumn("a", rank).where(F.col("a") <= per_author)
        if used:
            left = F.create_map(*[F.lit(v) for pair in used.items() for v in pair])
            mine = mine.where(F.col("a") <= per_author - F.coalesce(F.try_element_at(left, F.col("author")), F.lit(0)))
        for k, r in enumerate(mine.orderBy("p", "o", "key").limit(per_cell).collect()):
            used[r.author] = used.get(r.author, 0) + 1
            out.append((sources[0], r.key, k + 1))
    kind = T.StructType().add("cell", T.StringType()).add("key", every.schema["key"].dataType).add("place", T.IntegerType())
    return rows.sparkSession.createDataFrame(out, kind)
