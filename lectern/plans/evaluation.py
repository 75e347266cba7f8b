"""Error rates, accounting, arms, candidates and gates over the test tables; importing this module registers the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluation, relations, study
from lectern.plans.registry import query
from lectern.storage import dealt

#: References are part names, hypotheses types; words become letters, so that a distance of texts is one of words.
PAIRS = """WITH p AS (SELECT p_partkey AS id, p_brand AS arm, p_size % 5 AS family, p_name || ' ' || p_brand AS reference, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS hypothesis FROM part),
w AS (SELECT *, regexp_extract_all(reference, '[\\p{L}\\p{M}\\p{N}]+') AS rw, regexp_extract_all(hypothesis, '[\\p{L}\\p{M}\\p{N}]+') AS hw FROM p), u AS (SELECT *, list_distinct(rw || hw) AS u FROM w),
s AS (SELECT id, arm, family, reference, hypothesis, levenshtein(reference, hypothesis) AS edits, length(reference) AS chars, len(rw) AS words,
levenshtein(array_to_string(list_transform(rw, lambda x: chr(CAST(64 + list_position(u, x) AS INT))), ''), array_to_string(list_transform(hw, lambda x: chr(CAST(64 + list_position(u, x) AS INT))), '')) AS word_edits FROM u)
"""


def pairs(t):
    reference = F.concat_ws(" ", "p_name", "p_brand")
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("arm"), (F.col("p_size") % 5).alias("family"), reference.alias("reference"), F.concat_ws(" ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("hypothesis"))


@query(PAIRS + "SELECT id, edits, word_edits, edits / chars::DOUBLE AS cer, word_edits / words::DOUBLE AS wer FROM s")
def error_rates(t):
    return evaluation.scored(pairs(t), "reference", "hypothesis").select("id", "edits", "word_edits", "cer", "wer")


@query(PAIRS + """, k AS (SELECT arm, list_sort(list(edits / chars::DOUBLE)) AS v, count(*) AS n FROM s GROUP BY 1) SELECT arm, s.n, cer_micro, wer_micro, cer_macro, cer_median, v[CAST(round_even(0.95 * (k.n - 1), 0) AS INT) + 1] AS cer_p95
FROM (SELECT arm, count(*) AS n, sum(edits) / sum(chars)::DOUBLE AS cer_micro, sum(word_edits) / sum(words)::DOUBLE AS wer_micro, avg(edits / chars::DOUBLE) AS cer_macro, median(edits / chars::DOUBLE) AS cer_median FROM s GROUP BY 1) s JOIN k USING (arm)""")
def engine_report(t):
    rows = evaluation.scored(pairs(t), "reference", "hypothesis")
    sums = rows.groupBy("arm").agg(F.count("*").alias("n"), evaluation.micro("edits", "chars").alias("cer_micro"), evaluation.micro("word_edits", "words").alias("wer_micro"), F.avg("cer").alias("cer_macro"), F.median("cer").alias("cer_median"))
    return sums.join(evaluation.nearest_rank(rows, "arm", "cer", 0.95), "arm").withColumnRenamed("nearest", "cer_p95")


@query(PAIRS + """, m AS (SELECT r.id IS NULL AS gone, reference, CASE WHEN r.id IS NULL THEN length(reference) ELSE edits END AS e, chars, CASE WHEN r.id IS NULL THEN words ELSE word_edits END AS we, words FROM s LEFT JOIN (SELECT id FROM s WHERE id % 10 <> 0) r USING (id))
SELECT count(*) AS n, count(*) FILTER (WHERE gone) AS missing, sum(e) / sum(chars)::DOUBLE AS cer, sum(we) / sum(words)::DOUBLE AS wer FROM m""")
def external_evaluation(t):
    rows = pairs(t)
    return evaluation.evaluated(rows.select("id", "reference", F.lit("line").alias("level")), rows.where("id % 10 <> 0").select("id", "hypothesis"))


@query("""WITH e AS (SELECT p_brand AS family, p_name AS ref, CASE WHEN p_size % 3 = 0 THEN p_name ELSE lower(p_type) END AS before, CASE WHEN p_size % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS after, p_size > 20 AS accepted FROM part),
d AS (SELECT *, levenshtein(before, ref) AS o, levenshtein(after, ref) AS n FROM e)
SELECT family, count(*) AS units, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND n < o) AS beneficial, count(*) FILTER (WHERE accepted AND n = o) AS neutral, count(*) FILTER (WHERE accepted AND n > o) AS harmful, count(*) FILTER (WHERE accepted AND before = ref AND after <> ref) AS damage,
count(*) FILTER (WHERE accepted AND n < o)::DOUBLE / nullif(count(*) FILTER (WHERE accepted), 0) AS beneficial_share, count(*) FILTER (WHERE accepted AND after = ref)::DOUBLE / nullif(count(*) FILTER (WHERE accepted), 0) AS exact_precision, count(*) FILTER (WHERE accepted) / count(*)::DOUBLE AS coverage FROM d GROUP BY 1""")
def edit_accounting_full(t):
    first, size = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size")
    rows = t("part").select(F.col("p_brand").alias("family"), F.col("p_name").alias("ref"), F.when(size % 3 == 0, F.col("p_name")).otherwise(F.lower("p_type")).alias("before"), F.when(size % 2 == 0, F.col("p_name")).otherwise(first).alias("after"), (size > 20).alias("ok"))
    return evaluation.edit_counts(rows, "ref", "before", "after", F.col("ok"), "family")


@query("""SELECT p_brand AS page, coalesce(sum(levenshtein(p_name, lower(p_type))) / nullif(sum(greatest(length(p_name), length(p_type))), 0)::DOUBLE, 0) AS disagreement, avg(CAST(p_name = lower(p_type) AS DOUBLE)) AS exact, count(*) AS lines FROM part GROUP BY 1""")
def disagreement_stats(t):
    rows = t("part").select(F.col("p_brand").alias("page"), F.col("p_name").alias("a"), F.lower("p_type").alias("b"))
    return evaluation.disagreement(rows, "page", "a", "b")


@query("""SELECT kind, count(*) AS checked, count(*) FILTER (WHERE contains(text, span)) AS preserved, count(*) FILTER (WHERE contains(text, span)) / count(*)::DOUBLE AS rate
FROM (SELECT text, unnest(['name', 'numeral']) AS kind, unnest([lower(lang), CAST(doc_id % 10 AS VARCHAR)]) AS span FROM documents WHERE lang IS NOT NULL) GROUP BY 1""")
def sensitive_spans(t):
    docs = t("documents").where("lang is not null")
    spans = docs.select("text", F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.lower("lang").alias("span")), F.struct(F.lit("numeral").alias("kind"), (F.col("doc_id") % 10).cast("string").alias("span")))).alias("s"))
    return evaluation.preserved(spans.select("text", "s.kind", "s.span"), "kind", "span", "text")


RECORDS = PAIRS + """, r AS (SELECT arm, family, edits / chars::DOUBLE AS cer, CASE WHEN id % 11 = 0 THEN 'unsupported' WHEN id % 7 = 0 THEN 'empty' ELSE 'ok' END AS state, CASE WHEN arm <> 'Brand#3' THEN id % 2 = 0 END AS accepted, CASE WHEN id % 2 = 0 THEN CASE id % 3 WHEN 0 THEN 'beneficial' WHEN 1 THEN 'neutral' ELSE 'harmful' END END AS edit_class, id % 4 = 0 AS exact FROM s WHERE arm <> 'Brand#4'),
f AS (SELECT arm, avg(m) AS macro_cer, count(*) AS families FROM (SELECT arm, family, avg(cer) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT arm, count(*) AS attempted, count(*) FILTER (WHERE state = 'ok') AS ok, count(*) FILTER (WHERE state = 'empty') AS failed, count(*) FILTER (WHERE state = 'unsupported') AS unsupported, count(accepted) AS asked, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND edit_class = 'beneficial') AS beneficial,
count(*) FILTER (WHERE accepted AND edit_class = 'neutral') AS neutral, count(*) FILTER (WHERE accepted AND edit_class = 'harmful') AS harmful, count(*) FILTER (WHERE accepted AND exact) AS hits FROM r GROUP BY 1),
a AS (SELECT DISTINCT p_brand AS arm FROM part), x AS (SELECT arm, CASE WHEN attempted IS NULL OR failed > 0 THEN 'failed' WHEN unsupported > 0 AND ok = 0 THEN 'unsupported' ELSE 'ok' END AS status, macro_cer, coalesce(attempted, 0) AS attempted, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, coalesce(unsupported, 0) AS unsupported, coalesce(accepted, 0) AS accepted,
coalesce(beneficial, 0) AS beneficial, coalesce(neutral, 0) AS neutral, coalesce(harmful, 0) AS harmful, coalesce(families, 0) AS families, CASE WHEN asked > 0 THEN accepted / attempted::DOUBLE END AS coverage, CASE WHEN asked > 0 AND accepted > 0 THEN hits / accepted::DOUBLE END AS exact_precision FROM a LEFT JOIN g USING (arm) LEFT JOIN f USING (arm))
"""


def records(t):
    i = F.col("id")
    rows = evaluation.scored(pairs(t), "reference", "hypothesis").where("arm <> 'Brand#4'")
    kind = F.when(i % 3 == 0, "beneficial").when(i % 3 == 1, "neutral").otherwise("harmful")
    return rows.select("arm", "family", "cer", F.when(i % 11 == 0, "unsupported").when(i % 7 == 0, "empty").otherwise("ok").alias("state"), F.when(F.col("arm") != "Brand#3", i % 2 == 0).alias("accepted"), F.when(i % 2 == 0, kind).alias("edit_class"), (i % 4 == 0).alias("exact"))


def arm_rows(t):
    return evaluation.arms(records(t), t("part").select(F.col("p_brand").alias("arm")).distinct())


@query(RECORDS + "SELECT * FROM x")
def baseline_table(t):
    return arm_rows(t)


@query(RECORDS + """, z AS (SELECT CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(beneficial) AS BIGINT) AS beneficial, CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(harmful) AS BIGINT) AS harmful FROM x)
SELECT "column", expected, expected AS found, true AS ok FROM (SELECT unnest(['accepted', 'beneficial', 'neutral', 'harmful']) AS "column", unnest([accepted, beneficial, neutral, harmful]) AS expected FROM z)""")
def reconciled_totals(t):
    rows, names = arm_rows(t), ["accepted", "beneficial", "neutral", "harmful"]
    stated = records(t).agg(F.count_if("accepted").alias("accepted"), *[F.count_if(F.col("accepted") & (F.col("edit_class") == k)).alias(k) for k in names[1:]])
    return evaluation.totals_agree(rows, stated, names)


FAMILIES = """WITH f AS (SELECT source AS family, avg(quality) AS a, avg(toxic) AS b FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1)"""


def families(t):
    rows = t("labels").join(t("documents").select("doc_id", F.col("source").alias("family")), "doc_id").where("family is not null")
    side = lambda c: rows.groupBy("family").agg(F.avg(c).alias("v"))
    return evaluation.effects(side("quality"), side("toxic"))


@query(FAMILIES + "SELECT family, a, b, b - a AS diff, avg(a) OVER () AS macro_a, avg(b) OVER () AS macro_b FROM f")
def paired_effects(t):
    rows = families(t)
    return rows.join(F.broadcast(rows.agg(F.avg("a").alias("macro_a"), F.avg("b").alias("macro_b"))))  # one row of means


@query(FAMILIES + """, p AS (SELECT row_number() OVER (ORDER BY family) - 1 AS pos, b - a AS v FROM f), n AS (SELECT count(*) AS n, avg(b - a) AS mean FROM f),
m AS (SELECT i, avg(v) AS m FROM range(10000) r(i), n, unnest(range(n.n)) u(j) JOIN p ON pos = ('0x' || substr(md5('contrast:' || i || ':' || j), 1, 8))::BIGINT % n.n GROUP BY 1)
SELECT (SELECT mean FROM n) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m""")
def primary_contrast(t):
    return study.bootstrap(families(t), "family", "diff", rounds=10_000, seed="contrast")


@query("""WITH f AS (SELECT source, max(toxic)::DOUBLE AS v, CAST(sum(toxic) AS BIGINT) AS events FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT row_number() OVER (ORDER BY source) - 1 AS pos, v FROM f), n AS (SELECT count(*) AS n, avg(v) AS mean, CAST(sum(events) AS BIGINT) AS events, count(*) FILTER (WHERE v > 0) AS harmed FROM f),
m AS (SELECT i, avg(v) AS m FROM range(10000) r(i), n, unnest(range(n.n)) u(j) JOIN p ON pos = ('0x' || substr(md5('harm:' || i || ':' || j), 1, 8))::BIGINT % n.n GROUP BY 1)
SELECT any_value(n.n) AS families, any_value(n.events) AS harm_events, any_value(n.harmed) AS families_with_harm, any_value(n.mean) AS fraction, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, false AS safety_claim_supported FROM m, n""")
def harm_rate_report(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").where("source is not null")
    return study.harm_report(rows, "source", "toxic")


@query()
def engine_proxies(t):
    from lectern.functions import scorers

    rows = pairs(t)
    return rows.groupBy("arm").agg(F.avg(scorers.difflib_ratio("reference", "hypothesis")).alias("similarity"), F.avg(relations.block_ratio(F.col("reference"))).alias("block_ratio"))


# --- Candidates and gates


@query("""WITH w AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size FROM part)
SELECT p_partkey, 'vote-7-0000' AS candidate_id, CASE WHEN p_size % 2 = 0 THEN 0 ELSE length(a) + 1 END AS start, CASE WHEN p_size % 2 = 0 THEN length(a) ELSE length(p_name) END AS "end", CASE WHEN p_size % 2 = 0 THEN a ELSE b END AS before, 'other ' || p_size AS after FROM w""")
def proposed_candidates(t):
    first, last = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    word = F.concat(F.lit("other "), F.col("p_size").cast("string"))
    other = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", word, last)).otherwise(F.concat_ws("  ", first, word))
    return evaluation.proposed(t("part").select("p_partkey", "p_name", other.alias("other")), "p_partkey", "p_name", "other", "vote", "7")


@query("""SELECT p_partkey, k, start, "end", before, after FROM (SELECT p_partkey, 0 AS k, CASE WHEN p_size % 2 = 0 THEN 0 ELSE length(a) + 1 END AS start, CASE WHEN p_size % 2 = 0 THEN length(a) ELSE length(p_name) END AS "end",
CASE WHEN p_size % 2 = 0 THEN a ELSE b END AS before, 'other ' || p_size AS after FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))""")
def disagreements_in_sql(t):
    """The same edits by the table function, called from SQL."""
    first, last = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    word = F.concat(F.lit("other "), F.col("p_size").cast("string"))
    rows = dealt(t("part").select("p_partkey", "p_name", "p_size")).select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", word, last)).otherwise(F.concat_ws("  ", first, word)).alias("other"))
    evaluation.register(rows.sparkSession)
    return rows.sparkSession.sql("SELECT p_partkey, d.k, d.start, d.end, d.before, d.after FROM {rows}, LATERAL disagreements(p_name, other) d", rows=rows)


@query("""WITH g AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || repeat('x', p_size % 4) END AS after, p_name AS before, CASE WHEN p_size % 7 > 0 THEN p_retailprice % 100 END AS confidence, p_partkey % 3 > 0 AS agreed FROM part),
s AS (SELECT p_partkey, CASE WHEN before = after THEN 'reject unchanged' WHEN length(after) - length(before) > 2 THEN 'reject edit_size' WHEN confidence IS NULL THEN 'abstain confidence' WHEN confidence >= 70 THEN 'reject confidence' WHEN NOT agreed THEN 'reject agreement' ELSE 'accept' END AS d FROM g)
SELECT p_partkey, split_part(d, ' ', 1) AS decision, nullif(split_part(d, ' ', 2), '') AS gate FROM s""")
def gate_chain(t):
    from lectern.operators import review

    after = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.repeat(F.lit("x"), F.col("p_size") % 4)))
    rows = t("part").select("p_partkey", F.col("p_name").alias("before"), after.alias("after"), F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice") % 100).alias("confidence"), (F.col("p_partkey") % 3 > 0).alias("agreed"))
    gates = [review.unchanged("before", "after"), review.edit_size("before", "after", 2), review.confidence_below("confidence", 70.0), review.agreement("agreed")]
    return review.decided(rows, gates).select("p_partkey", "decision", "gate")


@query("""SELECT page, CAST(count(*) AS BIGINT) AS candidates, sha256('[' || string_agg('{"start":' || start || ',"end":' || stop || ',"after":"' || after || '","candidate_id":' || id || ',"before":"a"}', ',' ORDER BY start, stop, after, id) || ']') AS bank_hash
FROM (SELECT o_custkey AS page, o_orderkey AS id, o_orderkey % 50 AS start, o_orderkey % 50 + 3 AS stop, o_orderstatus AS after FROM orders) GROUP BY 1""")
def candidate_bank(t):
    rows = t("orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderkey") % 50).alias("start"), (F.col("o_orderkey") % 50 + 3).alias("end"), F.lit("a").alias("before"), F.col("o_orderstatus").alias("after"))
    return evaluation.bank(rows, "page").select("page", F.col("candidates").cast("long").alias("candidates"), "bank_hash")


@query("""WITH s AS (SELECT n_chars / 10000.0::DOUBLE AS score, quality, toxic FROM documents JOIN labels USING (doc_id)), g AS (SELECT k / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE quality = 1 AND least(100, floor(least(1.0, score) * 100)) >= k) AS good, count(*) FILTER (WHERE toxic = 1 AND least(100, floor(least(1.0, score) * 100)) >= k) AS bad FROM range(101) r(k), s GROUP BY k)
SELECT threshold, good, bad FROM g ORDER BY bad, good DESC, threshold DESC LIMIT 1""")
def chosen_threshold(t):
    rows = t("documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 10000).alias("score")).join(t("labels"), "doc_id")
    return evaluation.best_threshold(study.threshold_grid(rows, "score", F.col("quality") == 1, F.col("toxic") == 1))


@query()
def calibrated_gate(t):
    rows = t("documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words")).join(t("labels"), "doc_id")
    model = evaluation.fit_logistic(rows, ["n_chars", "words"], F.col("quality"))
    return rows.select("doc_id", F.round(model.probability(), 6).alias("probability"), evaluation.calibrated(model.probability(), 0.8).alias("decision"))


@query("""WITH s AS (SELECT count(*) FILTER (WHERE quality = 1) AS g, count(*) FILTER (WHERE toxic = 1) AS b FROM labels) SELECT CASE WHEN g >= 100 AND b >= 100 THEN 'calibrated' ELSE 'rule_based_fallback' END AS method, CASE WHEN g >= 100 AND b >= 100 THEN 'calibration-event screen supported' ELSE 'calibration-event screen not met' END AS reason FROM s""")
def gate_promotion(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return evaluation.promoted(relations.calibration_screen(rows, "source", F.col("quality") == 1, F.col("toxic") == 1))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'blue ' || split_part(p_name, ' ', 2) ELSE p_name END AS line FROM part""")
def transferred_edits(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    before = F.when(F.col("p_size") % 2 == 0, F.array(first, F.lit(""))).otherwise(F.array(F.substring(first, 1, 2), F.lit("e")))
    return t("part").select("p_partkey", evaluation.transfer_edits("p_name", before, F.array(F.lit("blue"), F.lit("x"))).alias("line"))


@query("""SELECT p_partkey, 'new ' || substr(p_name, length(split_part(p_name, ' ', 1)) + 2) || '!' AS text FROM part""")
def applied_decisions(t):
    from lectern.operators.review import spliced

    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    edit = lambda a, b, old, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), old.alias("before"), F.lit(new).alias("after"))
    n = F.char_length("p_name")
    edits = F.array(edit(F.lit(0), F.char_length(first), first, "new"), edit(n, n, F.lit(""), "!"))
    return t("part").select("p_partkey", spliced(F.col("p_name"), edits).alias("text"))


@query()
def line_omissions(t):
    said = t("conversations").groupBy("conv_id").agg(F.array_compact(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("x"))
    lines = lambda role: F.flatten(F.transform(F.filter("x", lambda v: v["role"] == role), lambda v: F.split(F.coalesce(v["text"], F.lit("")), "\n")))
    return evaluation.omissions(said.select("conv_id", lines("user").alias("census"), lines("assistant").alias("predicted")), "conv_id", "census", "predicted")
