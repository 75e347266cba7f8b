"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import catalogue, duplicates, evaluation, signatures, study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of tables under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- Duplicates

@query("""WITH d AS (SELECT doc_id, n_chars, sha256(text) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha ORDER BY n_chars DESC, doc_id) AS keeper_id, count(*) OVER (PARTITION BY sha) AS group_size
FROM d QUALIFY count(*) OVER (PARTITION BY sha) > 1""")
def dedupe_exact_keepers(t):
    return duplicates.exact_groups(t("documents"))


@query("""WITH d AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256(text)) AS a, first_value(lang) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS kind FROM documents)
SELECT a, doc_id AS b, CASE WHEN lang IS NOT DISTINCT FROM kind THEN 'duplicate' ELSE 'format_variant' END AS relation FROM d WHERE doc_id <> a""")
def copy_edges(t):
    return duplicates.copy_edges(t("documents"))


@query("""WITH g AS (SELECT doc_id, min(doc_id) OVER w AS cluster_id, count(*) OVER w AS size FROM documents WINDOW w AS (PARTITION BY sha256(text)))
SELECT doc_id, cluster_id, size, size > 8 AS review FROM g WHERE size > 1""")
def dup_clusters(t):
    return duplicates.clusters(duplicates.copy_edges(t("documents")))


@query("""WITH g AS (SELECT sha256(text) AS s, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, CAST(sum(n - 1) AS BIGINT) AS removable, count(*) FILTER (WHERE n > 8) AS review FROM g""")
def cluster_summary(t):
    groups = t("documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.sum(F.col("n") - 1).alias("removable"), F.count(F.when(F.col("n") > 8, 1)).alias("review"))


@query("""WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper_id FROM documents)
SELECT doc_id, keeper_id FROM d WHERE doc_id <> keeper_id""")
def safe_removals(t):
    edges = duplicates.copy_edges(t("documents"))
    members = duplicates.clusters(edges)
    return duplicates.safe_removals(members, edges, members.groupBy("cluster_id").agg(F.min("doc_id").alias("keeper_id")))


@query("""SELECT a.doc_id, count(*) FILTER (WHERE b.doc_id <> a.doc_id) AS links FROM documents a JOIN documents b ON a.source = b.source
AND greatest(a.n_chars, b.n_chars) - least(a.n_chars, b.n_chars) <= greatest(1, floor(least(a.n_chars, b.n_chars) * 0.02)) WHERE a.n_chars > 0 AND b.n_chars > 0 GROUP BY 1""")
def page_count_range_join(t):
    return duplicates.near_lengths(t("documents"))


# --- Catalogue

@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def catalogue_stats(t):
    return t("documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_coverage(t):
    return catalogue.coverage(t("documents"), "source")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%9_1%'")
def title_contains(t):
    return t("customer").where(catalogue.contains(F.col("c_name"), "9_1")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def list_by_offset(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query("SELECT p_name, p_partkey FROM part WHERE (p_name, p_partkey) > ('m', 0) ORDER BY 1, 2 LIMIT 25")
def keyset_page(t):
    return catalogue.page_after(t("part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], ("m", 0), 25)


@query("""SELECT kind, id, title FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_name FROM customer) WHERE title ILIKE '%00_1%'""")
def entity_search_union(t):
    found = catalogue.entities({"part": (t("part"), "p_partkey", "p_name"), "supplier": (t("supplier"), "s_suppkey", "s_name"), "customer": (t("customer"), "c_custkey", "c_name")})
    return found.where(catalogue.contains(F.col("title"), "00_1"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def readable_semi(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_anti(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def bridge_distinct(t):
    lines = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    return t("orders").where("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()


@query("""SELECT n_name, r_name, count(c_custkey) AS customers, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS segments
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def fts_document_rows(t):
    people = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("segments", F.lit("")).alias("segments"))


@query("SELECT count(quality) AS ratings, avg(quality) AS average FROM labels")
def community_rating(t):
    return t("labels").agg(F.count("quality").alias("ratings"), F.avg("quality").alias("average"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'rejected' WHEN p_retailprice >= 1000 THEN 'validated' ELSE 'candidate' END AS status FROM part")
def asset_status_case(t):
    return t("part").select("p_partkey", F.when(F.col("p_size") < 10, "rejected").when(F.col("p_retailprice") >= 1000, "validated").otherwise("candidate").alias("status"))


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3")
def cover_rank(t):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t("part").select("p_partkey", "p_brand", rank.alias("rank")).where("rank <= 3")


@query("""WITH c AS (SELECT doc_id, len(tk) AS len, len(list_filter(tk, lambda x: x = 'the')) AS a, len(list_filter(tk, lambda x: x = 'worthless')) AS b
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS tk FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))
 + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)), 6) AS score FROM c, s WHERE a > 0 OR b > 0""")
def bm25_scores(t):
    return catalogue.bm25(t("documents"), ["the", "worthless"]).withColumn("score", F.round("score", 6))


# --- Text

@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')) AS tokens FROM documents")
def word_tokens(t):
    return t("documents").select("doc_id", F.size(X.word_tokens(F.col("text"))).alias("tokens"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def strip_tags_text(t):
    return t("pages").select("page_id", X.without_tags(F.col("html")).alias("body"))


@query(r"""SELECT doc_id, trim(regexp_replace(translate(nfc_normalize(text), '‘’“”', '''''""'), '\s+', ' ', 'g')) AS view FROM documents""")
def text_policy_views(t):
    return t("documents").select("doc_id", X.search_view(F.col("text")).alias("view"))


@query("SELECT doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')), 0) AS ratio FROM documents")
def script_ratio(t):
    return t("documents").select("doc_id", F.try_divide(F.char_length(F.regexp_replace("text", "[^a-zA-Z]", "")).cast("double"), F.char_length(F.regexp_replace("text", "[ \\t\\n\\r]", ""))).alias("ratio"))


@query("""WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS b FROM part),
c AS (SELECT p_partkey, b, list_sum(list_transform(range(1, 10), lambda i: (11 - i) * CAST(substr(b, CAST(i AS INT), 1) AS INT))) AS s,
 list_sum(list_transform(range(1, 13), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) * CAST(substr('978' || b, CAST(i AS INT), 1) AS INT))) AS w FROM d)
SELECT p_partkey, '978' || b || CAST((10 - w % 10) % 10 AS INT) AS isbn13 FROM c""")
def isbn_checksum(t):
    body = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    last = F.pmod(-sum(((11 - i) * F.substring("b", i, 1).cast("int") for i in range(1, 10)), F.lit(0)), F.lit(11))
    ten = F.concat("b", F.when(last == 10, "X").otherwise(last.cast("string")))
    return t("part").select("p_partkey", body.alias("b")).select("p_partkey", X.isbn13(ten).alias("isbn13"))


# --- Evaluation

@query("""WITH p AS (SELECT p_brand, p_name AS a, p_type AS b FROM part)
SELECT p_brand, CAST(sum(levenshtein(a, lower(b))) AS BIGINT) AS edits, CAST(sum(length(a)) AS BIGINT) AS chars, sum(levenshtein(a, lower(b)))::DOUBLE / sum(length(a)) AS micro, avg(levenshtein(a, lower(b))::DOUBLE / length(a)) AS macro FROM p GROUP BY 1""")
def micro_macro_report(t):
    a, b = F.col("p_name"), F.lower("p_type")
    edits = F.levenshtein(a, b).cast("long")
    return t("part").groupBy("p_brand").agg(F.sum(edits).alias("edits"), F.sum(F.char_length(a).cast("long")).alias("chars"), F.try_divide(F.sum(edits).cast("double"), F.sum(F.char_length(a))).alias("micro"), F.avg(X.error_rate(a, b)).alias("macro"))


@query("""WITH x AS (SELECT l_returnflag, l_quantity AS q FROM lineitem), s AS (SELECT l_returnflag, list_sort(list(q)) AS v, count(*) AS n, quantile_cont(q, 0.95) AS linear FROM x GROUP BY 1)
SELECT l_returnflag, linear, v[CAST(round_even(0.95 * (n - 1), 0) AS INT) + 1] AS nearest FROM s""")
def percentile_ways(t):
    lines = t("lineitem").select("l_returnflag", "l_quantity")
    linear = lines.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.95)).alias("linear"))
    return linear.join(evaluation.nearest_rank(lines, "l_returnflag", "l_quantity", 0.95), "l_returnflag")


@query("""SELECT source, count(*) AS labelled, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS beneficial, count(*) FILTER (WHERE toxic = 1) AS harmful,
count(*) FILTER (WHERE toxic = 1)::DOUBLE / nullif(count(*) FILTER (WHERE quality = 1), 0) AS harm_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def edit_accounting(t):
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    joined = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(good & ~bad).alias("beneficial"), F.count_if(bad).alias("harmful"), F.try_divide(F.count_if(bad).cast("double"), F.count_if(good)).alias("harm_rate"))


@query("SELECT user_id, count(*) AS attempted, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY 1")
def failure_denominators(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").alias("ok"))


# --- Windows, sampling, votes, gates

@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(t):
    return study.newest(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""WITH m AS (SELECT user_id, CAST(event_type = 'error' AS INT) AS s, sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, run, CAST(sum(1 - s) AS BIGINT) AS n FROM m GROUP BY 1, 2) SELECT user_id, arg_max(n, run) AS current, max(n) AS best FROM r GROUP BY 1""")
def streak_current_best(t):
    return study.streaks(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls FROM events GROUP BY 1, 2")
def quota_by_day(t):
    return t("events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"))


@query("SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap_us FROM events")
def call_pacing(t):
    return study.gaps(t("events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").select("event_id", "gap_us")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""WITH p AS (SELECT o_orderkey, ('0x' || substr(md5('s1' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS h FROM orders)
SELECT o_orderkey, CASE WHEN h < 0.7 THEN 'train' WHEN h >= 0.7 AND h < 0.7 + 0.2 THEN 'test' ELSE 'unassigned' END AS split FROM p""")
def assign_splits(t):
    return study.splits(t("orders"), "o_orderkey", [("train", 0.7), ("test", 0.2)], "s1")


@query("""WITH h AS (SELECT source, doc_id, ('0x' || substr(md5('p7' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS h, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, least(1.0::DOUBLE, 5 / n::DOUBLE) AS probability FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY h, doc_id) <= 5""")
def probability_sample(t):
    return study.sample_per_group(t("documents").select("source", "doc_id"), "source", "doc_id", 5, "p7")


@query(r"""WITH v AS (SELECT conv_id, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, CASE WHEN count(DISTINCT role) = 2 AND count(DISTINCT x) = 1 AND min(CAST(x <> '' AS INT)) = 1 THEN 'provisional_accept' ELSE 'conflict' END AS status FROM v GROUP BY 1""")
def quorum_triage(t):
    return study.quorum(t("conversations"), "conv_id", "role", X.collapsed(F.col("text")), ["user", "assistant"])


@query("""WITH s AS (SELECT least(100, floor(least(1.0, n_chars / 10000.0::DOUBLE) * 100)) AS c, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT g / 100.0::DOUBLE AS threshold, count(c) AS accepted, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad FROM range(101) r(g) LEFT JOIN s ON c >= g GROUP BY g""")
def threshold_grid(t):
    rows = t("documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 10000).alias("score")).join(t("labels"), "doc_id")
    return study.threshold_grid(rows, "score", F.col("quality") == 1, F.col("toxic") == 1)


@query("""WITH f AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS bad FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT CAST(sum(n) AS BIGINT) AS tn, CAST(sum(bad) AS BIGINT) AS tb FROM f)
SELECT source, abs((tb - bad) / nullif((tn - n)::DOUBLE, 0) - tb / tn::DOUBLE) AS shift FROM f, s""")
def loo_stability(t):
    fam = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"))
    total = fam.agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"))
    return fam.crossJoin(F.broadcast(total)).select("source", F.abs(F.try_divide(F.col("tb") - F.col("bad"), (F.col("tn") - F.col("n")).cast("double")) - F.try_divide(F.col("tb"), F.col("tn"))).alias("shift"))


# --- Signatures, resampling, agreement, queues

@query("""WITH s AS (SELECT min(vec_id) AS id, sig FROM (SELECT vec_id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS sig FROM embeddings WHERE embedding IS NOT NULL) GROUP BY sig)
SELECT a.id AS a, b.id AS b, CAST(hamming(a.sig, b.sig) AS INT) AS distance FROM s a JOIN s b ON a.id < b.id AND hamming(a.sig, b.sig) <= 10""")
def signbit_hamming_pairs(t):
    return signatures.hamming_pairs(t("embeddings"), "vec_id", signatures.sign_bits("embedding", 64), 10)


@query("""WITH v AS (SELECT vec_id AS id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS sig FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT min(id) AS class_id, count(*) AS members, sig FROM v GROUP BY sig), l AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.class_id <> b.class_id AND hamming(a.sig, b.sig) <= 10 GROUP BY 1)
SELECT id, class_id, members, coalesce(links, 0) AS links FROM v JOIN c USING (sig) LEFT JOIN l USING (class_id)""")
def signbit_hamming_members(t):
    return signatures.hamming_members(t("embeddings"), "vec_id", signatures.sign_bits("embedding", 64), 10)


@query("""WITH f AS (SELECT source, avg(toxic) AS v FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT row_number() OVER (ORDER BY source) - 1 AS pos, v FROM f), n AS (SELECT count(*) AS n, avg(v) AS mean FROM f),
m AS (SELECT i, avg(v) AS m FROM range(10000) r(i), n, unnest(range(n.n)) u(j) JOIN p ON pos = ('0x' || substr(md5('b:' || i || ':' || j), 1, 8))::BIGINT % n.n GROUP BY 1)
SELECT (SELECT mean FROM n) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m""")
def harm_bootstrap(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").where("source is not null")
    return study.bootstrap(rows.groupBy("source").agg(F.avg("toxic").alias("v")), "source", "v")


@query("""WITH v AS (SELECT conv_id, role, min(text) AS t FROM conversations GROUP BY 1, 2 HAVING min(text) IS NOT NULL)
SELECT a.role AS a, b.role AS b, count(*) AS pages, avg(CAST(a.t = b.t AS DOUBLE)) AS rate FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY 1, 2""")
def pairwise_agreement(t):
    return study.agreement(t("conversations"), "conv_id", "role", "text")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def host_parts(t):
    return t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+([,;:!?।])', '\1', 'g'), '\s+', ' ', 'g')) AS line FROM documents")
def line_normalize(t):
    return t("documents").select("doc_id", X.line(F.col("text")).alias("line"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY 1""")
def token_counts(t):
    return t("documents").select(F.explode(X.word_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS attempts, CAST(least(3600, 60 * pow(2, count(*) FILTER (WHERE event_type = 'error'))) AS BIGINT) AS wait_s FROM events GROUP BY 1")
def retry_backoff(t):
    failed = F.count_if(F.col("event_type") == "error")
    return t("events").groupBy("user_id").agg(F.count("*").alias("attempts"), F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), failed)).cast("long").alias("wait_s"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY value, ts, event_id LIMIT 1")
def next_job(t):
    return t("events").where("event_type = 'error'").orderBy("value", "ts", "event_id").select("event_id", "user_id", "value").limit(1)


@query("SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS calls FROM events GROUP BY 1, 2")
def quota_by_month(t):
    return t("events").groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"))


@query("SELECT * FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def orphan_sweep(t):
    lines = t("lineitem")
    return lines.join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
