"""Scoring of transcriptions: error rates, accounting of edits, arms and their contrasts, candidates and gates."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from lectern.functions import scorers
from lectern.functions.text import nfc, word_tokens

# --- Error rates


def scored(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``rows`` with edits, chars, word_edits, words, cer and wer of a hypothesis; a missing one counts as empty, and a
    reference without text is an error, never a perfect match."""
    ref = F.when(F.coalesce(F.trim(reference), F.lit("")) == "", F.raise_error(F.lit("a reference without text")).cast("string")).otherwise(F.col(reference))
    hyp = F.coalesce(F.col(hypothesis), F.lit(""))
    words = lambda c: F.coalesce(word_tokens(c), F.array().cast("array<string>"))
    out = rows.withColumns({"edits": scorers.char_distance(ref, hyp).cast("long"), "chars": F.char_length(ref).cast("long"), "word_edits": scorers.sequence_distance(words(ref), words(hyp)).cast("long"), "words": F.size(words(ref)).cast("long")})
    return out.withColumns({"cer": F.col("edits") / F.col("chars"), "wer": F.try_divide(F.col("word_edits").cast("double"), F.col("words"))})


def micro(edits: str, size: str) -> Column:
    """Sum of edits over sum of reference sizes; null without any."""
    return F.try_divide(F.sum(edits).cast("double"), F.sum(size))


def nearest_rank(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, nearest): the value at index round(p * (n - 1)), halves to even, of each group's values in order. Values are
    counted first, so a group holds a row for each distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(value))
    total = counts.groupBy(group).agg(F.sum("_n").alias("_all"))
    placed = counts.withColumn("_upto", upto).join(total, group)
    return placed.where(F.col("_upto") > F.bround(F.lit(p) * (F.col("_all") - 1))).groupBy(group).agg(F.min(value).alias("nearest"))


def edit_counts(rows: DataFrame, reference: str, before: str, after: str, accepted: Column, by: str) -> DataFrame:
    """Accounting of edits by group: units, accepted, beneficial, neutral, harmful, exact, damage to right text, shares of
    the accepted (null without any) and coverage."""
    old, new = F.levenshtein(before, reference), F.levenshtein(after, reference)
    n, of = F.count_if(accepted), lambda c: F.count_if(accepted & c)
    exact = F.col(after) == F.col(reference)
    return rows.groupBy(by).agg(F.count("*").alias("units"), n.alias("accepted"), of(new < old).alias("beneficial"), of(new == old).alias("neutral"), of(new > old).alias("harmful"), of((F.col(before) == F.col(reference)) & ~exact).alias("damage"),
                                F.try_divide(of(new < old).cast("double"), n).alias("beneficial_share"), F.try_divide(of(exact).cast("double"), n).alias("exact_precision"), (n / F.count("*")).alias("coverage"))


def disagreement(rows: DataFrame, page: str, a: str, b: str) -> DataFrame:
    """(page, disagreement, exact, lines): edits over the longer sides' characters, and the share of equal lines."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return rows.groupBy(page).agg(F.coalesce(F.try_divide(F.sum(F.levenshtein(a, b)).cast("double"), F.sum(longer)), F.lit(0.0)).alias("disagreement"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.count("*").alias("lines"))


def preserved(spans: DataFrame, kind: str, span: str, text: str) -> DataFrame:
    """(kind, checked, preserved, rate): how many spans of each kind their text still holds."""
    held = F.coalesce((F.col(span) != "") & F.contains(F.col(text), F.col(span)), F.lit(False))
    return spans.groupBy(kind).agg(F.count("*").alias("checked"), F.count_if(held).alias("preserved"), (F.count_if(held) / F.count("*")).alias("rate"))


def evaluated(refs: DataFrame, hypotheses: DataFrame, key: str = "id") -> DataFrame:
    """One row: references (id, reference, level), missing hypotheses (id, hypothesis), micro CER and WER. References of
    several levels (pages, lines) are refused."""
    joined = scored(refs.join(hypotheses.withColumn("_there", F.lit(True)), key, "left"), "reference", "hypothesis")
    one = F.when(F.countDistinct("level") > 1, F.raise_error(F.lit("references of several levels"))).otherwise(F.count("*"))
    return joined.agg(one.cast("long").alias("n"), F.count_if(F.col("_there").isNull()).alias("missing"), F.coalesce(micro("edits", "chars"), F.lit(0.0)).alias("cer"), F.coalesce(micro("word_edits", "words"), F.lit(0.0)).alias("wer"))


# --- Arms


def arms(records: DataFrame, roster: DataFrame) -> DataFrame:
    """A row for each arm of ``roster`` (arm), also for those without records: status (worst state of its pages), macro CER
    (mean of family means), pages attempted, ok, failed and unsupported, decisions, coverage (null where no decision was
    made) and exact precision (null where nothing was accepted).

    ``records`` has (arm, family, cer, state, accepted, edit_class, exact); ``accepted`` is null where no decision was asked.
    """
    state = F.coalesce("state", F.lit("ok"))
    ok, unsupported = state.isin("ok", ""), state == "unsupported"
    took = F.coalesce("accepted", F.lit(False))
    known = F.when(took & ~F.coalesce(F.col("edit_class").isin("beneficial", "neutral", "harmful"), F.lit(False)), F.raise_error(F.lit("an accepted correction without a class")).cast("string")).otherwise(F.col("edit_class"))
    sums = records.withColumn("edit_class", known).groupBy("arm").agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("ok"), F.count_if(~ok & ~unsupported).alias("failed"), F.count_if(unsupported).alias("unsupported"), F.count("accepted").alias("asked"), F.count_if(took).alias("accepted"),
        *[F.count_if(took & (F.col("edit_class") == k)).alias(k) for k in ("beneficial", "neutral", "harmful")], F.count_if(took & F.coalesce("exact", F.lit(False))).alias("hits"))
    macro = records.groupBy("arm", "family").agg(F.avg("cer").alias("m")).groupBy("arm").agg(F.avg("m").alias("macro_cer"), F.count("*").alias("families"))
    joined = roster.join(sums, "arm", "left").join(macro, "arm", "left")
    status = F.when(F.col("attempted").isNull() | (F.col("failed") > 0), "failed").when((F.col("unsupported") > 0) & (F.col("ok") == 0), "unsupported").otherwise("ok")
    coverage = F.when(F.col("asked") > 0, F.col("accepted") / F.col("attempted"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("attempted", "ok", "failed", "unsupported", "accepted", "beneficial", "neutral", "harmful", "families")]
    return joined.select("arm", status.alias("status"), "macro_cer", *zero, coverage.alias("coverage"), F.when(coverage > 0, F.try_divide(F.col("hits").cast("double"), F.col("accepted"))).alias("exact_precision"))


STORED = "arm_id string, family string, reference string, hypothesis string, accepted boolean, edit_class string, status string, exact boolean, _bad string"


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``arms`` takes, rebuilt from stored predictions: JSON lines with arm_id, family, reference and hypothesis,
    and a decision where one was made. Error rates are computed again over both texts in NFC; a missing hypothesis counts as
    empty. A line that is no JSON, or without arm, family or reference, is an error when it is read; blank lines go."""
    said = F.from_json("value", STORED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(said.alias("r")).select("r.*")
    told = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    problem = F.when(F.col("_bad").isNotNull(), "a line that is no JSON").when(~(told("arm_id") & told("family") & told("reference")), "a record without arm, family or reference")
    arm = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("arm_id"))
    texts = rows.select(arm.alias("arm"), "family", nfc(F.col("reference")).alias("reference"), nfc(F.coalesce("hypothesis", F.lit(""))).alias("hypothesis"), "accepted", "edit_class", F.coalesce("status", F.lit("ok")).alias("state"), "exact")
    cer = scorers.char_distance(F.col("reference"), F.col("hypothesis")) / F.char_length("reference")
    return texts.select("arm", "family", cer.alias("cer"), "state", "accepted", "edit_class", "exact")


def effects(a: DataFrame, b: DataFrame, family: str = "family", value: str = "v") -> DataFrame:
    """(family, a, b, diff) of two systems over the same families; a family that only one has, or that one has twice, is an
    error when it is read."""
    one = lambda d, n: d.groupBy(family).agg(F.first(value).cast("double").alias(n), F.count("*").alias(f"_{n}"))
    joined = one(a, "a").join(one(b, "b"), family, "full")
    wrong = F.coalesce((F.col("_a") != 1) | (F.col("_b") != 1), F.lit(True))
    diff = F.when(wrong, F.raise_error(F.concat(F.lit("no pair for family "), F.col(family))).cast("double")).otherwise(F.col("b") - F.col("a"))
    return joined.select(family, "a", "b", diff.alias("diff"))


def totals_agree(rows: DataFrame, totals: DataFrame, columns: list[str]) -> DataFrame:
    """(column, expected, found, ok): whether stated totals are the sums of the rows."""
    found = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns]).unpivot([], columns, "column", "found")
    said = totals.select(*[F.col(c).cast("long").alias(c) for c in columns]).unpivot([], columns, "column", "expected")
    return said.join(found, "column").select("column", "expected", "found", F.col("expected").eqNullSafe(F.col("found")).alias("ok"))


# --- Candidates and gates

CANDIDATE = "start int, end int, before string, after string"


def disagreements(base: str, other: str) -> list[dict]:
    """Edits that turn the words of one text into those of another, at their places in the first."""
    spans = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", base)]
    words = other.split()
    out = []
    for kind, i, j, k, n in difflib.SequenceMatcher(None, [s[0] for s in spans], words, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        if i < j:
            start, end = spans[i][1], spans[j - 1][2]
        else:
            start = end = spans[i][1] if i < len(spans) else spans[-1][2] if spans else 0
        out.append({"start": start, "end": end, "before": base[start:end], "after": " ".join(words[k:n])})
    return out


@pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("before", T.StringType()).add("after", T.StringType())))
def _disagreements(base: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([disagreements(a or "", b or "") for a, b in zip(base, other)], dtype=object)


class Disagreements:
    """``disagreements(base, other)`` as a table function: a row for each edit, numbered from 0; null counts as empty."""

    def eval(self, base: str | None, other: str | None):
        for k, e in enumerate(disagreements(base or "", other or "")):
            yield k, e["start"], e["end"], e["before"], e["after"]


def register(spark: SparkSession) -> None:
    """Makes ``disagreements`` known to SQL, with rows in Arrow batches: ``FROM pages, LATERAL disagreements(base, other)``."""
    kind = T.StructType([T.StructField(n, t) for n, t in zip(("k", "start", "end", "before", "after"), [T.IntegerType()] * 3 + [T.StringType()] * 2)])
    spark.udtf.register("disagreements", udtf(Disagreements, returnType=kind, useArrow=True))


def proposed(pages: DataFrame, page: str, base: str, other: str, proposer: str, seed: str) -> DataFrame:
    """(candidate_id, page, start, end, before, after): a candidate for each place at which two readings of a page differ."""
    found = pages.select(page, F.posexplode(_disagreements(base, other)).alias("k", "c"))
    name = F.concat(F.lit(f"{proposer}-{seed}-"), F.lpad(F.col("k").cast("string"), 4, "0"))
    return found.select(name.alias("candidate_id"), page, "c.start", "c.end", "c.before", "c.after")


def bank(candidates: DataFrame, page: str) -> DataFrame:
    """(page, candidates, bank_hash): each page's candidates in the order of their places, under a hash that any change alters."""
    order = F.array_sort(F.collect_list(F.struct("start", "end", "after", "candidate_id", "before")))
    return candidates.groupBy(page).agg(order.alias("c")).select(page, F.size("c").alias("candidates"), F.sha2(F.to_json("c"), 256).alias("bank_hash"))


class Logistic:
    """A standardised logistic model."""

    def __init__(self, names: list[str], mean: list[float], scale: list[float], weights: list[float], bias: float):
        self.names, self.mean, self.scale, self.weights, self.bias = names, mean, scale, weights, bias

    def probability(self) -> Column:
        """Of the label, as a column expression; null where a feature is."""
        z = sum(((F.col(n) - m) / s * w for n, m, s, w in zip(self.names, self.mean, self.scale, self.weights)), F.lit(self.bias))
        return 1 / (1 + F.exp(-z))


def fit_logistic(rows: DataFrame, names: list[str], label: Column, l2: float = 1.0, steps: int = 500, rate: float = 0.1, most: int = 200_000) -> Logistic:
    """Gradient descent on standardised features with an L2 penalty. Rows are first counted by features and label, so the
    driver gets a row for each distinct one, of at most ``most`` by hash; means and deviations are of all rows."""
    full = rows.select(*[F.col(n).cast("double").alias(n) for n in names], label.cast("double").alias("_y")).dropna()
    stats = full.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    counted = full.groupBy(*names, "_y").agg(F.count("*").alias("_n")).orderBy(F.xxhash64(*names, "_y")).limit(most).toPandas()
    if not len(counted):
        raise ValueError("no rows to fit on")
    mean, scale = [stats[f"m_{n}"] for n in names], [max(1e-9, stats[f"s_{n}"]) for n in names]
    x, y, n = (counted[names].to_numpy() - mean) / scale, counted["_y"].to_numpy(), counted["_n"].to_numpy(float)
    w, bias, total = np.zeros(len(names)), 0.0, n.sum()
    for _ in range(steps):
        off = n * (1 / (1 + np.exp(-(x @ w + bias))) - y)
        w, bias = w - rate * (off @ x / total + l2 * w / total), bias - rate * off.sum() / total
    return Logistic(names, mean, scale, w.tolist(), float(bias))


def calibrated(probability: Column, threshold: float) -> Column:
    """accept from the threshold on, else abstain; abstain where the probability is not known."""
    return F.when(F.coalesce(probability >= threshold, F.lit(False)), "accept").otherwise("abstain")


def best_threshold(grid: DataFrame) -> DataFrame:
    """Of a grid (threshold, good, bad), the threshold with the least harm, then the most good, then the highest."""
    return grid.agg(F.min(F.struct("bad", (-F.col("good")).alias("g"), (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("threshold"), (-F.col("m.g")).alias("good"), "m.bad")


def promoted(screen: DataFrame) -> DataFrame:
    """The method that a calibration screen allows, and why."""
    ok = F.col("supported")
    return screen.select(F.when(ok, "calibrated").otherwise("rule_based_fallback").alias("method"), F.when(ok, "calibration-event screen supported").otherwise("calibration-event screen not met").alias("reason"))


def transferred(line: str, edits) -> str:
    """A line with the edits (before, after) that stand in it exactly once, between characters of no word."""
    for before, after in edits:
        if not before or line.count(before) != 1:
            continue
        at = line.index(before)
        end = at + len(before)
        if re.match(r"\w", line[at - 1:at]) or re.match(r"\w", line[end:end + 1]):
            continue
        line = line[:at] + after + line[end:]
    return line


@pandas_udf(T.StringType())
def transfer_edits(line: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else transferred(s, zip(b if b is not None else [], a if a is not None else [])) for s, b, a in zip(line, before, after)], dtype=object)


# --- Lines


def match_lines(census: list[str], predicted: list[str], least: float = 0.70) -> tuple[int, int, int]:
    """(matched, omitted, spurious): each census line in order takes the unused predicted line with the best ratio of 1 -
    edits / longer length, the first of equals, if that is ``least`` or more."""
    used: set[int] = set()
    for line in census:
        best, at = 0.0, -1
        for j, other in enumerate(predicted):
            if j in used or not line or not other:
                score = 1.0 if j not in used and not line and not other else 0.0
            elif min(len(line), len(other)) / max(len(line), len(other)) <= max(best, least - 1e-9):
                score = 0.0 if line != other else 1.0  # no longer line can be so near
            else:
                score = 1 - scorers.distance(line, other) / max(len(line), len(other))
            if score > best:
                best, at = score, j
        if at >= 0 and best >= least - 1e-12:
            used.add(at)
    return len(used), len(census) - len(used), len(predicted) - len(used)


def omissions(pages: DataFrame, page: str, census: str, predicted: str, least: float = 0.70) -> DataFrame:
    """(page, census_lines, matched, omitted, spurious) for each page with arrays of census and predicted lines."""
    kind = T.StructType().add("matched", T.LongType()).add("omitted", T.LongType()).add("spurious", T.LongType())

    @pandas_udf(kind)
    def matched(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([match_lines(list(x), list(y), least) for x, y in zip(a, b)], columns=["matched", "omitted", "spurious"])

    return pages.select(page, F.size(census).cast("long").alias("census_lines"), matched(census, predicted).alias("m")).select(page, "census_lines", "m.*")
