"""Catalogue queries: lookups, filters, joins, counts, ranks, paging and sets; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import catalogue, relations
from lectern.plans.registry import query

# --- Lookups and filters


@query("""SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey = 7 UNION ALL SELECT 'document', doc_id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 3)""")
def point_lookup(t):
    docs = t("documents")
    sha = docs.where("doc_id = 3").select(F.sha2("text", 256).alias("sha"))
    same = docs.join(F.broadcast(sha), F.sha2(docs["text"], 256) == F.col("sha"), "left_semi")  # one row at most
    return catalogue.entities({"part": (catalogue.lookup(t("part"), p_partkey=7), "p_partkey", "p_name"), "document": (same, "doc_id", "source")}).drop("title")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%pplier#%0_%1%'")
def author_contains(t):
    return t("supplier").where(catalogue.contains(F.col("s_name"), "pplier#%0_%1")).select("s_suppkey", "s_name")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def dynamic_conjunction(t):
    return catalogue.lookup(t("documents"), lang="de", source="src3", doc_id=None).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small w')")
def prefix_match(t):
    return t("part").where(F.col("p_name").startswith("small w")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (2, 3, 5, 7)")
def in_list(t):
    return t("customer").where(F.col("c_nationkey").isin(2, 3, 5, 7)).select("c_custkey")


@query("""SELECT d.doc_id, l.toxic IS NOT DISTINCT FROM l.quality AS same FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def null_safe_equality(t):
    docs, labels = t("documents"), t("labels")
    return docs.join(labels, docs["doc_id"].eqNullSafe(labels["doc_id"]), "left").select(docs["doc_id"], F.col("toxic").eqNullSafe(F.col("quality")).alias("same"))


@query("""SELECT event_id, props IS NULL OR trim(props) IN ('', '{}') AS blank FROM events""")
def blank_payload(t):
    return t("events").select("event_id", relations.blank_json(F.col("props")).alias("blank"))


@query("SELECT p_partkey, p_name FROM part WHERE trim(p_name) NOT IN ('cold widget', 'red bolt', 'small gear')")
def title_denylist(t):
    return t("part").where(~relations.denied(F.col("p_name"), ["cold widget", "red bolt", "small gear"])).select("p_partkey", "p_name")


@query("""WITH a AS (SELECT p_partkey, p_name, string_split(p_name || ' ' || p_type || '  widget', ' ') AS names FROM part)
SELECT p_partkey, array_to_string(list_filter(names, lambda x: trim(x) <> '' AND x <> p_name AND x NOT IN ('widget', 'bolt')), '|') AS authors FROM a""")
def clean_authors(t):
    names = F.split(F.concat_ws(" ", "p_name", "p_type", F.lit(" widget")), " ")
    return t("part").select("p_partkey", F.array_join(relations.clean_authors(names, F.col("p_name"), ["widget", "bolt"]), "|").alias("authors"))


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 60")
def text_region_filter(t):
    return t("conversations").where(relations.text_regions(F.col("role"), F.char_length("text") <= 60, ["user", "assistant"])).select("conv_id", "turn")


@query("""SELECT event_id, regexp_matches(props, '"(gold|reference|k)"\\s*:') AS leaked FROM events""")
def gold_leak_guard(t):
    return t("events").select("event_id", relations.has_field(F.col("props"), ["gold", "reference", "k"]).alias("leaked"))


@query("""SELECT event_id, json_merge_patch(props, '{"k": null}')::VARCHAR AS payload FROM events""")
def blind_payload(t):
    return t("events").select("event_id", relations.without_fields(F.col("props"), ["k"]).alias("payload"))


@query("SELECT conv_id, bool_or(contains(lower(text), 'user') OR contains(lower(text), 'assistant') OR contains(lower(text), 'the')) AS names_voter FROM conversations GROUP BY 1")
def blind_string_scan(t):
    return t("conversations").groupBy("conv_id").agg(F.bool_or(relations.mentions(F.lower("text"), ["user", "assistant", "the"])).alias("names_voter"))


# --- Joins


@query("SELECT event_id, c_name, value FROM events JOIN customer ON user_id = c_custkey")
def reviews_with_users(t):
    return t("events").join(t("customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "value")


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25""")
def records_with_snapshots(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(t("part").where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "p_name")


@query("""SELECT p_brand, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS sources FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def work_sources(t):
    flags = t("lineitem").select("l_partkey", "l_returnflag").distinct()
    return t("part").join(flags, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("sources"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def semi_or_branches(t):
    people = t("customer")
    rich = people.join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
    near = people.join(t("nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    return rich.union(near).distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT o_orderkey, (SELECT min(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS smallest FROM orders ORDER BY smallest NULLS FIRST, o_orderkey LIMIT 40""")
def smallest_first(t):
    least = t("lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("smallest"))
    return t("orders").join(least, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "smallest").orderBy(F.asc_nulls_first("smallest"), "o_orderkey").limit(40)


@query("SELECT l.doc_id, l.toxic, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def predictions_with_gold(t):
    return relations.complete_join(t("labels"), t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "toxic", "n_chars")


@query("""SELECT source, count(*) AS refs, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, CAST(sum(length(coalesce(CAST(l.quality AS VARCHAR), ''))) AS BIGINT) AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def references_with_missing(t):
    said = relations.with_default(t("documents").select("doc_id", "source"), t("labels").select("doc_id", F.col("quality").cast("string").alias("hypothesis")), "doc_id", "hypothesis")
    return said.groupBy("source").agg(F.count("*").alias("refs"), F.count_if("missing").alias("missing"), F.sum(F.char_length("hypothesis").cast("long")).alias("chars"))


@query("""SELECT a.conv_id, a.turn, a.role AS left_role, b.role AS right_role, a.text = b.text AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 WHERE a.role = 'user'""")
def engine_pairs(t):
    left = t("conversations").select("conv_id", "turn", F.col("role").alias("left_role"), F.col("text").alias("a")).where("left_role = 'user'")
    right = t("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("right_role"), F.col("text").alias("b"))
    return left.join(right, ["conv_id", "turn"]).select("conv_id", "turn", "left_role", "right_role", (F.col("a") == F.col("b")).alias("same"))


@query("""SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""")
def without_non_keepers(t):
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    keeper = docs.groupBy("sha").agg(F.min("doc_id").alias("keeper"))
    lost = docs.join(keeper, "sha").where("doc_id <> keeper").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select("doc_id")


@query("""WITH m AS (SELECT doc_id, sha256(text) AS c FROM documents), f AS (SELECT DISTINCT c FROM m JOIN documents USING (doc_id) WHERE source = 'src1')
SELECT m.c AS cluster, count(*) AS siblings, min(m.doc_id) AS first_id FROM m JOIN f ON m.c = f.c GROUP BY 1""")
def family_siblings(t):
    docs = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("cluster"))
    return relations.siblings(docs, "doc_id", "cluster", F.col("source") == "src1")


# --- Counts and measures


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 0) AS present FROM documents GROUP BY 1")
def state_counts(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 0).alias("present"))


@query("SELECT o_orderstatus AS status, count(*) AS identities FROM orders GROUP BY 1")
def identities_by_status(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("identities"))


@query("""SELECT count(DISTINCT c_custkey) AS books FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def distinct_with_optional_join(t):
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey")).agg(F.countDistinct("c_custkey").alias("books"))


@query("""SELECT source, count(*) AS total, count(quality) AS completed, count(*) - count(quality) AS remaining, CASE WHEN count(*) = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * count(quality) / count(*), 1) END AS percent,
count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def review_progress_by_decision(t):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return relations.progress(rows.groupBy("source"), F.col("quality"), {"accepted": 1, "rejected": 0})


@query("""WITH r AS (SELECT user_id, ts, event_id, event_type = 'error' AS skip, value FROM events), s AS (SELECT *, sum(CAST(skip AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r),
b AS (SELECT user_id, run, count(*) FILTER (WHERE NOT skip) AS n FROM s GROUP BY 1, 2), k AS (SELECT user_id, arg_max(n, run) AS current_streak, max(n) AS best_streak FROM b GROUP BY 1)
SELECT user_id, count(*) AS reviewed, count(*) FILTER (WHERE NOT skip) AS verified, CAST(sum(CASE WHEN skip THEN 0 ELSE floor(value) END) AS BIGINT) AS xp, any_value(current_streak) AS current_streak, any_value(best_streak) AS best_streak,
round(count(*) FILTER (WHERE NOT skip) / greatest(1.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE), 4) AS per_hour FROM r JOIN k USING (user_id) GROUP BY 1""")
def gold_stats(t):
    return relations.gold_stats(t("events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("skip"), "value"))


@query("""SELECT count(DISTINCT conv_id) AS pages, count(*) FILTER (WHERE role = 'assistant') AS submitted, count(DISTINCT CASE WHEN text IS NULL THEN conv_id END) AS open_conflicts, count(*) FILTER (WHERE role = 'user') AS drafts FROM conversations""")
def annotation_progress(t):
    return t("conversations").agg(F.countDistinct("conv_id").alias("pages"), F.count_if(F.col("role") == "assistant").alias("submitted"), F.countDistinct(F.when(F.col("text").isNull(), F.col("conv_id"))).alias("open_conflicts"), F.count_if(F.col("role") == "user").alias("drafts"))


@query("""SELECT o_orderkey AS page, count(l_orderkey) AS regions, count(*) FILTER (WHERE l_linestatus = 'O') AS pending FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def coverage_queue(t):
    pending = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("regions"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))
    joined = t("orders").join(pending, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("page"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("regions", "pending")])


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'todo' WHEN l.quality = 1 THEN 'submitted' ELSE 'draft' END AS status, count(l.doc_id) OVER (PARTITION BY source) AS drafted, count(*) OVER (PARTITION BY source) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def assignment_overview(t):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "todo").when(F.col("quality") == 1, "submitted").otherwise("draft")
    by = rows.groupBy("source").agg(F.count("quality").alias("drafted"), F.count("*").alias("total"))
    return rows.join(by, "source").select("doc_id", status.alias("status"), "drafted", "total")


@query("""SELECT 'status ' || o_orderstatus AS what, count(*) AS n, CAST(NULL AS DOUBLE) AS amount FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'distinct', count(DISTINCT o_custkey), NULL FROM orders
UNION ALL SELECT 'failures', count(*), sum(o_totalprice) FROM orders WHERE o_orderpriority = '5-LOW'""")
def inventory_report(t):
    orders, none = t("orders"), F.lit(None).cast("double").alias("amount")
    by = orders.groupBy(F.concat(F.lit("status "), "o_orderstatus").alias("what")).agg(F.count("*").alias("n")).select("what", "n", none)
    one = orders.agg(F.countDistinct("o_custkey").alias("n")).select(F.lit("distinct").alias("what"), "n", none)
    bad = orders.where("o_orderpriority = '5-LOW'").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amount")).select(F.lit("failures").alias("what"), "n", "amount")
    return by.union(one).union(bad)


@query("""SELECT count(*) AS entries, count(*) FILTER (WHERE status = 'ok') AS completed, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'deferred') AS deferred,
count(*) FILTER (WHERE status = 'unreadable') AS damaged, count(*) FILTER (WHERE status = 'not_a_book') AS not_a_book, count(*) FILTER (WHERE status = 'empty') AS empty
FROM (SELECT CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 40 THEN 'not_a_book' WHEN n_chars > 100000 THEN 'unreadable' WHEN l.doc_id IS NULL THEN 'deferred' WHEN l.quality = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def manifest_buckets(t):
    rows = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") < 40, "not_a_book").when(F.col("n_chars") > 100000, "unreadable").when(F.col("quality").isNull(), "deferred").when(F.col("quality") == 1, "ok").otherwise("ambiguous")
    return relations.status_buckets(rows.select(status.alias("status")))


@query("""SELECT event_type AS engine, count(*) AS n, avg(value) AS mean, median(value) AS median, avg(CAST(value > 400 AS DOUBLE)) AS error_rate,
CASE WHEN count(*) >= 20 THEN quantile_cont(value, 0.95) END AS p95 FROM events GROUP BY 1""")
def engine_timing(t):
    v = F.col("value")
    return t("events").groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.avg((v > 400).cast("double")).alias("error_rate"), F.when(F.count("*") >= 20, F.percentile(v, F.lit(0.95))).alias("p95"))


@query("""SELECT source, CAST(sum(n_chars * quality) AS DOUBLE) / nullif(CAST(sum(n_chars) AS DOUBLE), 0) AS confidence FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def weighted_confidence(t):
    rows = t("documents").select("doc_id", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("source").agg(relations.weighted_mean(F.col("quality"), F.col("n_chars")).alias("confidence"))


@query("""SELECT l_orderkey, CAST(sum(length(w) * conf) AS DOUBLE) / sum(length(w)) AS confidence, min(conf) AS lowest, min(x0) AS x0, max(x1) AS x1, bool_or(conf < 20) AS suspicious, string_agg(w, ' ' ORDER BY l_linenumber, w) AS text
FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || CAST(l_partkey AS VARCHAR) AS w, l_quantity AS conf, l_suppkey AS x0, l_suppkey + 10 AS x1 FROM lineitem) GROUP BY 1""")
def line_confidence(t):
    word = F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    words = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), word.alias("word"), F.col("l_quantity").alias("conf"), F.col("l_suppkey").alias("x0"), (F.col("l_suppkey") + 10).alias("x1"))
    return relations.line_confidence(words, "l_orderkey", 20.0)


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT sha256(text)) FROM documents) AS contents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(DISTINCT source) FROM documents) AS work_groups, CAST(NULL AS BIGINT) AS ocr_jobs""")
def inventory_counters(t):
    docs = t("documents").agg(F.count("*").alias("documents"), F.countDistinct(F.sha2("text", 256)).alias("contents"), F.countDistinct("source").alias("work_groups"))
    return relations.counters(docs, t("labels").agg(F.count("*").alias("labelled"))).withColumn("ocr_jobs", F.lit(None).cast("long"))


@query("""SELECT lang, source, count(*) AS n, greatest(0, 30 - count(*)) AS short FROM documents GROUP BY 1, 2""")
def cells_short(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.greatest(F.lit(0), 30 - F.count("*")).alias("short"))


@query("""SELECT count(*) AS seen, count(*) FILTER (WHERE quality IS NOT NULL) AS materialized, count(*) FILTER (WHERE quality IS NULL) AS skipped FROM documents LEFT JOIN labels USING (doc_id)""")
def materialization_report(t):
    rows = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.agg(F.count("*").alias("seen"), F.count("quality").alias("materialized"), F.count_if(F.col("quality").isNull()).alias("skipped"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS newest FROM events GROUP BY 1""")
def newest_by_time(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("newest"))


@query("""WITH f AS (SELECT source, avg(quality) AS m FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT count(*) AS families, avg(m) AS macro FROM f""")
def macro_by_family(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.avg("quality").alias("m")).agg(F.count("*").alias("families"), F.avg("m").alias("macro"))


@query("""SELECT source, count(*) FILTER (WHERE quality = 1) AS accepted, CASE WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN count(*) FILTER (WHERE toxic = 1 AND quality = 1)::DOUBLE / count(*) FILTER (WHERE quality = 1) END AS harm,
count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*) AS coverage FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def harm_coverage_points(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return relations.harm_points(rows, "source", F.col("quality") == 1, F.col("toxic") == 1)


@query("""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad FROM labels JOIN documents USING (doc_id) GROUP BY 1),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad, count(*) AS families FROM s),
x AS (SELECT max(abs((t.good - s.good) / nullif((t.n - s.n)::DOUBLE, 0) - t.good / t.n::DOUBLE)) AS shift, bool_and(t.n > s.n) AS rest FROM s, t)
SELECT good AS beneficial, bad AS harmful, families, shift, coalesce(families >= 2 AND rest AND shift <= 0.15, false) AS stable, good >= 100 AND bad >= 100 AND families >= 10 AND coalesce(families >= 2 AND rest AND shift <= 0.15, false) AS supported FROM t, x""")
def calibration_screen(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return relations.calibration_screen(rows, "source", F.col("quality") == 1, F.col("toxic") == 1)


@query("""WITH s AS (SELECT source, avg(abs(quality - toxic)) AS diff, avg(CAST(quality = toxic AS DOUBLE)) AS exact FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, diff > 0.01 OR exact < 0.95 AS blocked, array_to_string(list_filter([CASE WHEN diff > 0.01 THEN 'character disagreement' END, CASE WHEN exact < 0.95 THEN 'exact lines' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def promotion_trigger(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    means = rows.groupBy("source").agg(F.avg(F.abs(F.col("quality") - F.col("toxic"))).alias("diff"), F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("exact"))
    return relations.promotion(means, {"character disagreement": F.col("diff") > 0.01, "exact lines": F.col("exact") < 0.95}).select("source", "blocked", F.array_join("reasons", ",").alias("reasons"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\x{0980}-\x{09FF}\x{0964}\x{0965}0-9]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\s', '', 'g')), 0) AS ratio FROM documents""")
def block_ratio(t):
    return t("documents").select("doc_id", relations.block_ratio(F.col("text")).alias("ratio"))


# --- Ranks, orders and pages


@query("""WITH m AS (SELECT user_id, ts, event_id, CAST(event_type = 'error' AS INT) AS s FROM events), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM m),
k AS (SELECT event_id, s, count(*) FILTER (WHERE s = 0) OVER (PARTITION BY user_id, coalesce(run, 0) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS streak FROM r)
SELECT event_id, CASE WHEN s = 1 THEN 0 ELSE least(20, 2 * (streak + 1)) END AS bonus FROM k""")
def streak_bonus(t):
    return relations.streak_bonus(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "bonus")


@query("""SELECT doc_id, max(n_chars) OVER (PARTITION BY sha256(text)) AS most_pages, min(n_chars) OVER (PARTITION BY source) AS least_size FROM documents""")
def cluster_extremes(t):
    docs = t("documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("sha"))
    most, least = docs.groupBy("sha").agg(F.max("n_chars").alias("most_pages")), docs.groupBy("source").agg(F.min("n_chars").alias("least_size"))
    return docs.join(most, "sha").join(least, "source").select("doc_id", "most_pages", "least_size")


@query("""SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) ORDER BY url, page_id) = 1 AS keeps FROM pages""")
def first_path_keeps(t):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return relations.first_keeps(t("pages").select("page_id", "url", host.alias("host")), "host", ["url", "page_id"]).select("page_id", "keeps")


@query("""SELECT title, id, kind FROM (SELECT p_name AS title, p_partkey AS id, 'part' AS kind FROM part UNION ALL SELECT s_name, s_suppkey, 'supplier' FROM supplier)
WHERE (lower(title), id, kind) > ('red bolt', 20, 'part') ORDER BY lower(title), id, kind LIMIT 26""")
def nocase_keyset_page(t):
    every = catalogue.entities({"part": (t("part"), "p_partkey", "p_name"), "supplier": (t("supplier"), "s_suppkey", "s_name")}).select("title", "id", "kind")
    rows = every.withColumn("key", F.lower("title"))
    return catalogue.page_after(rows, ["key", "id", "kind"], ("red bolt", 20, "part"), 26).drop("key")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS turn, o_totalprice FROM orders ORDER BY turn, o_totalprice DESC, o_orderkey LIMIT 30""")
def accepted_first(t):
    turn = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return t("orders").select("o_orderkey", turn.alias("turn"), "o_totalprice").orderBy("turn", F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 100""")
def bounded_pools(t):
    return relations.pools(t("part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 100)


@query("""(SELECT 'low' AS side, doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 5) UNION ALL (SELECT 'high', doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)""")
def extremes_by_agreement(t):
    return relations.both_ends(t("documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 5)


@query("""SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3""")
def worst_items(t):
    return relations.top_per_group(t("documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 3)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, first_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first_id) <= 3""")
def first_occurrences(t):
    return relations.first_occurrences(t("events"), "user_id", "event_type", "event_id", 3)


@query("""WITH g AS (SELECT min(doc_id) AS first_id, count(*) AS size FROM documents GROUP BY sha256(text) HAVING count(*) > 1) SELECT row_number() OVER (ORDER BY size DESC, first_id) AS place, first_id, size FROM g ORDER BY 1 LIMIT 20""")
def cluster_order(t):
    groups = t("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")).where("size > 1")
    top = groups.orderBy(F.desc("size"), "first_id").limit(20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("size"), "first_id")).alias("place"), "first_id", "size")


@query("""SELECT p_partkey, base64(encode('{"id":' || p_partkey || ',"kind":"part","title":"' || p_name || '"}')) AS cursor FROM part""")
def opaque_cursor(t):
    given = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("title")))
    return t("part").select("p_partkey", F.base64(F.encode(given, "UTF-8")).alias("cursor"))


# --- Sets


@query("""SELECT id FROM (SELECT p_partkey AS id FROM part WHERE p_size < 5 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_name = 'red bolt')""")
def candidate_union(t):
    part = t("part")
    pools = [part.where("p_size < 5").select(F.col("p_partkey").alias("id")), t("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id")), part.where("p_name = 'red bolt'").select(F.col("p_partkey").alias("id"))]
    return relations.pooled(pools)


@query("""WITH n AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS a FROM customer GROUP BY 1), s AS (SELECT n_nationkey AS k, ['BUILDING', 'MACHINERY', 'SPACE'] AS b FROM nation)
SELECT k, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS common, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS missing, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS extra FROM n JOIN s USING (k)""")
def set_differences(t):
    got = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("a"))
    return relations.differences(got, F.col("a"), F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "SPACE")])).select("k", *[F.array_join(c, ",").alias(c) for c in ("common", "missing", "extra")])


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [split_part(p_name, ' ', 2), lower(p_type)] AS b, [split_part(p_name, ' ', 2)] AS c FROM part)
SELECT p_partkey, array_to_string(list_filter(a, lambda x: list_contains(b, x) AND list_contains(c, x)), ',') AS shared FROM w""")
def shared_across_signals(t):
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    signals = F.array(F.split("p_name", " "), F.array(second, F.lower("p_type")), F.array(second), F.array().cast("array<string>"))
    return t("part").select("p_partkey", F.array_join(relations.shared_names(signals), ",").alias("shared"))


@query("""SELECT o_orderkey, 'challenge' AS split FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('c' || o_orderkey), o_orderkey) <= 20)""")
def challenge_sample(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority")
    taken = relations.top_per_group(orders, "o_orderpriority", [F.md5(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))), F.col("o_orderkey")], 20)
    return relations.challenge(orders.where("o_orderkey % 3 = 0"), taken, "o_orderkey").select("o_orderkey", "split")
