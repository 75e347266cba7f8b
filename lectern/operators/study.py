"""Studies: percentiles, accounting of edits, sampling, votes, gates, streaks, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import portable_hash


def gaps(rows: DataFrame, key: str, ts: str, order: str, width: str = "1 hour") -> DataFrame:
    """``rows`` with ``gap_us``: microseconds since the row before of the same key. A key's rows are dealt by stretches of
    ``width``; the last time of the stretch before, of which there is one row each, is carried over the border."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    cell = F.date_trunc("hour", ts) if width == "1 hour" else F.window(ts, width)["start"]
    marked = rows.withColumn("_cell", cell)
    inside = F.lag(ts).over(Window.partitionBy(key, "_cell").orderBy(ts, order))
    ends = marked.groupBy(key, "_cell").agg(F.max(ts).alias("_end"))
    carried = ends.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), F.lag("_end").over(Window.partitionBy(key).orderBy("_cell")).alias("_carry"))
    joined = marked.withColumn("_before", inside).join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_c")), "left")
    return joined.withColumn("gap_us", micros(F.col(ts)) - micros(F.coalesce("_before", "_carry"))).drop("_cell", "_before", "_k", "_c", "_carry")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def streaks(rows: DataFrame, key: str, order: list[str], skip: Column) -> DataFrame:
    """(key, current, best): rows since the last skipped one, and the longest run without one."""
    upto = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_skip", skip.cast("int")).withColumn("_run", F.sum("_skip").over(upto))
    runs = marked.groupBy(key, "_run").agg(F.sum(1 - F.col("_skip")).alias("n"))
    return runs.groupBy(key).agg(F.max_by("n", "_run").alias("current"), F.max("n").alias("best"))


def splits(families: DataFrame, key: str, quotas: list[tuple[str, float]], seed: str) -> DataFrame:
    """(key, split): a family's place by hash falls into the share of a split, or behind all shares: unassigned.

    Shares are of the hash's range, so a family's split does not depend on other families and needs no sort."""
    place, edge, out = portable_hash(F.concat(F.lit(seed), F.col(key).cast("string"))) / float(1 << 32), 0.0, F.lit("unassigned")
    for name, share in reversed([(n, (sum(q for _, q in quotas[:i]), sum(q for _, q in quotas[:i + 1]))) for i, (n, _) in enumerate(quotas)]):
        out = F.when((place >= share[0]) & (place < share[1]), name).otherwise(out)
    return families.select(key, out.alias("split"))


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group by hash, with the probability of each: min(1, k / size)."""
    by_hash = Window.partitionBy(group).orderBy("_h", key)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = rows.withColumn("_h", portable_hash(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= k)
    return ranked.join(sizes, group).select(group, key, F.least(F.lit(1.0), k / F.col("_n")).alias("probability"))


def quorum(votes: DataFrame, page: str, voter: str, text: Column, voters: list[str]) -> DataFrame:
    """(page, status): accepted if all voters are there, none empty, and all say the same; else conflict."""
    said = votes.withColumn("_t", text).where(F.col(voter).isin(voters)).groupBy(page).agg(F.countDistinct(voter).alias("v"), F.countDistinct("_t").alias("t"), F.min((F.col("_t") != "").cast("int")).alias("ok"))
    return said.select(page, F.when((F.col("v") == len(voters)) & (F.col("t") == 1) & (F.col("ok") == 1), "provisional_accept").otherwise("conflict").alias("status"))


def threshold_grid(rows: DataFrame, score: str, good: Column, bad: Column, steps: int = 100) -> DataFrame:
    """(threshold, accepted, good, bad) for thresholds 0, 1/steps .. 1: rows with a score at or above each.

    Rows are counted by the last threshold that they pass, and the counts are summed from above: a row is read once
    however many thresholds there are."""
    cell = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col(score) * steps))).cast("int")
    cells = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("accepted"), F.sum(good.cast("long")).alias("good"), F.sum(bad.cast("long")).alias("bad"))
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("cell"))
    above = Window.orderBy(F.desc("cell"))  # over the grid's steps + 1 rows
    full = grid.join(cells, "cell", "left").na.fill(0)
    return full.select((F.col("cell") / steps).alias("threshold"), *[F.sum(c).over(above).alias(c) for c in ("accepted", "good", "bad")])


def bootstrap(families: DataFrame, family: str, value: str, rounds: int = 10_000, seed: str = "b") -> DataFrame:
    """(mean, low, high): the mean of the families' values and its 95 % interval over resamples of families.

    Draw j of round i takes the family at position md5(seed:i:j) mod n in the order of families. ``families`` has one row
    for each; only the rounds' sums are gathered."""
    at = families.select((F.row_number().over(Window.orderBy(family)) - 1).alias("at"), F.col(value).cast("double").alias("v"))
    n = families.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    draws = families.sparkSession.range(rounds).withColumnRenamed("id", "i").crossJoin(F.broadcast(n)).where("n > 0")  # n: one row
    drawn = draws.select("i", "n", "mean", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    place = portable_hash(F.concat_ws(":", F.lit(seed), F.col("i").cast("string"), F.col("j").cast("string"))) % F.col("n")
    means = drawn.withColumn("at", place.cast("int")).join(at, "at").groupBy("i").agg(F.avg("v").alias("m"), F.first("mean").alias("mean"))
    return means.agg(F.first("mean").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def harm_report(rows: DataFrame, family: str, harmful: str, rounds: int = 10_000, seed: str = "harm") -> DataFrame:
    """One row: families, harmful events, families with any, their share and its interval over resamples of families. No
    number of resamples shows that harm is rare, so no claim of safety is ever supported."""
    sums = rows.groupBy(family).agg(F.max(harmful).cast("double").alias("v"), F.sum(harmful).alias("events"))
    counts = sums.agg(F.count("*").alias("families"), F.sum("events").alias("harm_events"), F.count_if(F.col("v") > 0).alias("families_with_harm"))
    interval = bootstrap(sums, family, "v", rounds, seed).withColumnRenamed("mean", "fraction")
    return counts.join(F.broadcast(interval)).withColumn("safety_claim_supported", F.lit(False))  # a row each


def agreement(votes: DataFrame, page: str, voter: str, text: str) -> DataFrame:
    """(a, b, pages, rate) for two voters a < b: the pages that both voted on, and the share on which their texts agree.

    A vote is a voter's smallest text for a page, so a page has at most a row for each voter."""
    one = votes.groupBy(page, voter).agg(F.min(text).alias("t")).where("t is not null")
    left, right = (one.select(page, F.col(voter).alias(s), F.col("t").alias(f"t_{s}")) for s in "ab")
    return left.join(right, page).where("a < b").groupBy("a", "b").agg(F.count("*").alias("pages"), F.avg((F.col("t_a") == F.col("t_b")).cast("double")).alias("rate"))


def agreement_by(votes: DataFrame, region: list[str], voter: str, text: str) -> DataFrame:
    """(a, b, regions, rate): of two voters, the regions that both read and the share on which they agree but for white
    space. Votes meet inside a region, of which there is one row a voter."""
    from lectern.functions.text import collapsed

    left, right = (votes.select(*region, F.col(voter).alias(s), collapsed(F.col(text)).alias(f"t_{s}")) for s in "ab")
    return left.join(right, region).where("a < b").groupBy("a", "b").agg(F.count("*").alias("regions"), F.round(F.avg((F.col("t_a") == F.col("t_b")).cast("double")), 4).alias("rate"))


def zero_filled(rows: DataFrame, key: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """(key, state, n): how often each key has each of ``states``, 0 included. One aggregation, no join with the states."""
    counted = rows.groupBy(key).agg(*[F.count(F.when(F.col(state) == s, 1)).alias(s) for s in states])
    return counted.unpivot(key, list(states), state, "n")


def stratified(rows: DataFrame, cells: list[str], key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of each cell, by the MD5 of seed and key, so reruns agree; null is a value of a cell."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(*cells).orderBy(order, key))
    return rows.withColumn("pick", rank).where(F.col("pick") <= most)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, n): a key's events with no pause longer than ``gap`` between them."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
