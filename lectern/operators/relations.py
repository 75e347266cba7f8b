"""Filters, joins, counts, ranks and sets that the catalogue's queries are made of."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Predicates


def blank_json(payload: Column) -> Column:
    """Whether a payload is null, blank or an empty object."""
    return payload.isNull() | F.trim(payload).isin("", "{}")


def denied(name: Column, denylist: list[str]) -> Column:
    """Whether a name, without blanks at its ends, is on a denylist."""
    return F.trim(name).isin(*denylist)


def clean_authors(names: Column, title: Column, denylist: list[str]) -> Column:
    """Names that are not blank, not the title and not on the denylist, in order."""
    return F.filter(names, lambda n: (F.trim(n) != "") & (n != title) & ~denied(n, denylist))


def text_regions(kind: Column, unreadable: Column, kinds: list[str]) -> Column:
    """Whether a region is of a kind that holds text and can be read."""
    return kind.isin(*kinds) & ~unreadable


def has_field(payload: Column, fields: list[str]) -> Column:
    """Whether a JSON payload names one of the fields at any depth."""
    return payload.rlike('"(' + "|".join(map(re.escape, fields)) + r')"\s*:')


def without_fields(payload: Column, fields: list[str]) -> Column:
    """A JSON object's other fields, as JSON with string values; null for what is no object."""
    return F.to_json(F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: ~k.isin(*fields)))


def mentions(text: Column, names: list[str]) -> Column:
    """Whether a text contains one of the names; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(n) for n in names]), F.lit(False))


def block_ratio(text: Column) -> Column:
    """Share of characters other than white space that are in the Bengali block, dandas or ASCII digits; null without any."""
    inside = F.char_length(F.regexp_replace(text, "[^\\u0980-\\u09FF\\u0964\\u09650-9]", ""))
    return F.try_divide(inside.cast("double"), F.char_length(F.regexp_replace(text, r"\s", "")))


# --- Joins


def complete_join(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Left rows with their right row; a left row without one is an error when it is read."""
    joined = left.join(right, key, "left")
    why = F.concat(F.lit(f"no {column} for {key} "), F.col(key).cast("string"))
    return joined.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(why)).otherwise(F.col(column)))


def with_default(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Left rows with the right text, empty where there is none, and whether it is ``missing``."""
    marked = right.withColumn("_found", F.lit(True))
    return left.join(marked, key, "left").withColumn("missing", F.col("_found").isNull()).withColumn(column, F.coalesce(column, F.lit(""))).drop("_found")


def siblings(members: DataFrame, key: str, cluster: str, chosen: Column) -> DataFrame:
    """(cluster, siblings, first_id) of each cluster with a chosen member."""
    named = members.where(chosen).select(cluster).distinct()
    return members.join(named, cluster).groupBy(cluster).agg(F.count("*").alias("siblings"), F.min(key).alias("first_id"))


# --- Counts


def progress(groups, decision: Column, kinds: dict[str, object]) -> DataFrame:
    """total, completed, remaining, percent to one place (100 without rows) and a count for each decision."""
    percent = F.when(F.count("*") == 0, 100.0).otherwise(F.round(100.0 * F.count(decision) / F.count("*"), 1))
    each = [F.count_if(decision == v).alias(k) for k, v in kinds.items()]
    return groups.agg(F.count("*").alias("total"), F.count(decision).alias("completed"), (F.count("*") - F.count(decision)).alias("remaining"), percent.alias("percent"), *each)


def gold_stats(reviews: DataFrame) -> DataFrame:
    """Reviews, verified, xp, current and best streak and verified rows an hour of each user of (user_id, ts, event_id, skip, value)."""
    run = F.sum(F.col("skip").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    runs = reviews.withColumn("run", run).groupBy("user_id", "run").agg(F.count_if(~F.col("skip")).alias("n"))
    streaks = runs.groupBy("user_id").agg(F.max_by("n", "run").alias("current_streak"), F.max("n").alias("best_streak"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = F.greatest(F.lit(1.0), (micros(F.max("ts")) - micros(F.min("ts"))) / 3600000000.0)
    verified = F.count_if(~F.col("skip"))
    sums = reviews.groupBy("user_id").agg(F.count("*").alias("reviewed"), verified.alias("verified"), F.sum(F.when(F.col("skip"), 0).otherwise(F.floor("value"))).alias("xp"), F.round(verified / hours, 4).alias("per_hour"))
    return sums.join(streaks, "user_id")


#: What a manifest's summary counts, by status.
BUCKETS = {"completed": "ok", "ambiguous": "ambiguous", "deferred": "deferred", "damaged": "unreadable", "not_a_book": "not_a_book", "empty": "empty"}


def status_buckets(entries: DataFrame) -> DataFrame:
    """One row: all entries, and those of each status."""
    return entries.agg(F.count("*").alias("entries"), *[F.count_if(F.col("status") == v).alias(k) for k, v in BUCKETS.items()])


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value by weight over the sum of weights; null without weight."""
    return F.try_divide(F.sum(value * weight).cast("double"), F.sum(weight).cast("double"))


def line_confidence(words: DataFrame, line: str, low: float) -> DataFrame:
    """Each line's confidence by characters, lowest confidence, extent, whether a word is below ``low``, and its text."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ")
    size = F.char_length("word")
    return words.groupBy(line).agg(weighted_mean(F.col("conf"), size).alias("confidence"), F.min("conf").alias("lowest"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.bool_or(F.col("conf") < low).alias("suspicious"), said.alias("text"))


def counters(*rows: DataFrame) -> DataFrame:
    """Tables of one row side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # a row each


def harm_points(rows: DataFrame, family: str, accepted: Column, harmful: Column) -> DataFrame:
    """Accepted rows, harmful ones among them (null without any) and coverage of each family."""
    n = F.count_if(accepted)
    return rows.groupBy(family).agg(n.alias("accepted"), F.try_divide(F.count_if(accepted & harmful).cast("double"), n).alias("harm"), (n / F.count("*")).alias("coverage"))


def calibration_screen(rows: DataFrame, family: str, good: Column, bad: Column, least_good: int = 100, least_bad: int = 100, least_families: int = 10, tolerance: float = 0.15) -> DataFrame:
    """One row: whether there are enough beneficial and harmful rows and families, and whether the share of beneficial rows
    moves by at most ``tolerance`` when any family is left out. Shares without a family come from totals less its sums."""
    sums = rows.groupBy(family).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    total = sums.agg(F.sum("n").alias("tn"), F.sum("good").alias("tg"), F.sum("bad").alias("tb"), F.count("*").alias("families"))
    shift = F.abs(F.try_divide((F.col("tg") - F.col("good")).cast("double"), F.col("tn") - F.col("n")) - F.try_divide(F.col("tg").cast("double"), F.col("tn")))
    out = sums.join(F.broadcast(total)).groupBy("tg", "tb", "families").agg(F.max(shift).alias("shift"), F.bool_and(F.col("tn") > F.col("n")).alias("rest"))  # total has one row
    stable = F.coalesce((F.col("families") >= 2) & F.col("rest") & (F.col("shift") <= tolerance), F.lit(False))
    enough = (F.col("tg") >= least_good) & (F.col("tb") >= least_bad) & (F.col("families") >= least_families)
    return out.select(F.col("tg").alias("beneficial"), F.col("tb").alias("harmful"), "families", "shift", stable.alias("stable"), (enough & stable).alias("supported"))


def promotion(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``rows`` with the reasons that hold, and whether any blocks them."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))
    return rows.withColumn("reasons", held).withColumn("blocked", F.size("reasons") > 0)


# --- Ranks


def streak_bonus(rows: DataFrame, key: str, order: list[str], skip: Column) -> DataFrame:
    """``rows`` with ``bonus``: min(20, 2 * (streak + 1)) by the rows since the last skip, 0 for a skip."""
    past = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_skip", skip.cast("int")).withColumn("_run", F.coalesce(F.sum("_skip").over(past), F.lit(0)))
    inside = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    streak = F.count(F.when(F.col("_skip") == 0, 1)).over(inside)
    return marked.withColumn("bonus", F.when(F.col("_skip") == 1, 0).otherwise(F.least(F.lit(20), 2 * (streak + 1)))).drop("_skip", "_run")


def first_keeps(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``keeps``: whether a row is the first of its key. The first is aggregated, so no key is sorted."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, key).withColumn("keeps", F.struct(*order) == F.col("_first")).drop("_first")


def top_per_group(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark ranks inside tasks before it shuffles."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def pools(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key by id, before anything is scored."""
    return top_per_group(rows, key, [F.col(order)], n)


def both_ends(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` lowest and the ``n`` highest rows."""
    low = rows.orderBy(value, key).limit(n).select(F.lit("low").alias("side"), "*")
    return low.union(rows.orderBy(F.desc(value), key).limit(n).select(F.lit("high").alias("side"), "*"))


def first_occurrences(rows: DataFrame, key: str, item: str, order: str, n: int) -> DataFrame:
    """The first ``n`` different items of each key, in the order in which they first occur."""
    firsts = rows.groupBy(key, item).agg(F.min(order).alias("first_id"))
    return top_per_group(firsts, key, [F.col("first_id")], n)


# --- Sets


def pooled(tables: list[DataFrame]) -> DataFrame:
    """The distinct rows of several tables."""
    return reduce(lambda a, b: a.union(b), tables).distinct()


def differences(rows: DataFrame, got: Column, wanted: Column) -> DataFrame:
    """``rows`` with the items in common, those missing from ``got`` and those it has beyond ``wanted``."""
    return rows.withColumns({"common": F.array_intersect(got, wanted), "missing": F.array_except(wanted, got), "extra": F.array_except(got, wanted)})


def shared_names(signals: Column) -> Column:
    """Names that all signals with any name share, in the order of the first; none without signals."""
    said = F.filter(signals, lambda s: F.size(s) > 0)
    return F.when(F.size(said) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(F.slice(said, 2, F.size(signals)), F.element_at(said, 1), lambda a, b: F.array_intersect(a, b)))


def challenge(candidates: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Candidates that are not in a sample taken before, stamped as challenge rows."""
    return candidates.join(taken, key, "left_anti").withColumn("split", F.lit("challenge"))


CURSOR = "id long, kind string, title string"


def decoded_cursor(rows: DataFrame, cursor: str) -> DataFrame:
    """``rows`` with ``at`` (id, kind, title) of an opaque cursor; null unless it is base64 of JSON with all three."""
    text = F.when(F.col(cursor).rlike("^[A-Za-z0-9+/_-]+={0,2}$") & (F.char_length(cursor) % 4 == 0), F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")))
    at = F.from_json(F.decode(text, "UTF-8"), CURSOR)
    return rows.withColumn("at", F.when(at["id"].isNotNull() & at["kind"].isNotNull() & at["title"].isNotNull(), at))


def dispatched(rows: DataFrame, by: str, registry: dict) -> DataFrame:
    """The results of each kind's own function (DataFrame to DataFrame) over its rows; a kind without one is an error."""
    known = F.when(F.col(by).isin(*registry), F.col(by)).otherwise(F.raise_error(F.concat(F.lit("no evaluator for "), F.coalesce(by, F.lit("null")))).cast("string"))
    checked = rows.withColumn(by, known)
    return reduce(DataFrame.unionByName, [f(checked.where(F.col(by) == kind)) for kind, f in registry.items()])
