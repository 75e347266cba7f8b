"""Queries on boxes, resolution and review; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import catalogue, resolution, review, spatial, study
from lectern.plans.registry import query

#: Boxes made of orders' keys: lines are small, regions large.
BOXES = """WITH k AS (SELECT o_orderkey AS id, o_custkey % 50 AS page, o_orderstatus AS s, o_orderkey * 37 % 1000 AS x0, o_orderkey * 91 % 1400 AS y0 FROM orders),
l AS (SELECT id, page, x0, y0, x0 + 20 + id % 180 AS x1, y0 + 12 + id % 20 AS y1 FROM k WHERE s <> 'F'), b AS (SELECT id, page, s, x0, y0, x0 + 100 + id % 400 AS x1, y0 + 60 + id % 300 AS y1 FROM k), r AS (SELECT * FROM b WHERE s = 'F')
"""


def boxes(orders, page: str = "o_custkey % 50"):
    k = orders.select(F.col("o_orderkey").alias("id"), F.expr(page).alias("page"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") * 37 % 1000).alias("x0"), (F.col("o_orderkey") * 91 % 1400).alias("y0"))
    size = lambda w, mw, h, mh: k.withColumn("x1", F.col("x0") + w + F.col("id") % mw).withColumn("y1", F.col("y0") + h + F.col("id") % mh)
    return size(20, 180, 12, 20).where("s <> 'F'"), size(100, 400, 60, 300)


@query(BOXES + """, p AS (SELECT l.id AS line, r.id AS region, ((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)))::DOUBLE / ((l.x1 - l.x0) * (l.y1 - l.y0)) AS share
FROM l JOIN r ON l.page = r.page AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)
SELECT line, region, share FROM p WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY line ORDER BY share DESC, region) = 1""")
def bbox_align(t):
    lines, regions = boxes(t("orders"))
    return spatial.assign(lines, regions.where("s = 'F'"), "page", "id")


@query(BOXES + "SELECT l.id AS line, min(r.id) AS region FROM l JOIN r ON l.page = r.page AND r.x0 <= l.x0 AND r.y0 <= l.y0 AND l.x1 <= r.x1 AND l.y1 <= r.y1 GROUP BY 1")
def bbox_containment(t):
    lines, regions = boxes(t("orders"))
    return spatial.containing(lines, regions.where("s = 'F'"), "page", "id")


@query(BOXES + """SELECT id, page FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.s = 'O' AND b.page = r.page AND b.x0 < r.x1 AND r.x0 < b.x1 AND b.y0 < r.y1 AND r.y0 < b.y1
AND ((least(b.x1, r.x1) - greatest(b.x0, r.x0)) * (least(b.y1, r.y1) - greatest(b.y0, r.y0)))::DOUBLE / ((b.x1 - b.x0) * (b.y1 - b.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - (least(b.x1, r.x1) - greatest(b.x0, r.x0)) * (least(b.y1, r.y1) - greatest(b.y0, r.y0))) >= 0.3)""")
def bbox_iou_omissions(t):
    _, regions = boxes(t("orders"))
    return spatial.omitted(regions.where("s = 'F'"), regions.where("s = 'O'"), "page", "id").select("id", "page")


@query("""WITH k AS (SELECT p_partkey, p_name, p_brand || '/' || p_type AS block, count(*) OVER (PARTITION BY p_brand || '/' || p_type) AS n FROM part), f AS (SELECT * FROM k WHERE n BETWEEN 2 AND 20)
SELECT a.p_partkey AS a, b.p_partkey AS b, 1.0::DOUBLE AS score FROM f a JOIN f b ON a.block = b.block AND a.p_partkey < b.p_partkey""")
def title_block_exact(t):
    return resolution.blocked_pairs(t("part"), "p_partkey", F.concat_ws("/", "p_brand", "p_type"), "p_name", lambda a, b: F.lit(1.0))


@query("""WITH k AS (SELECT p_partkey, p_name, p_brand || '/' || p_size AS block, count(*) OVER (PARTITION BY p_brand || '/' || p_size) AS n FROM part), f AS (SELECT * FROM k WHERE n BETWEEN 2 AND 500),
s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) AS score FROM f a JOIN f b ON a.block = b.block AND a.p_partkey < b.p_partkey)
SELECT * FROM s WHERE score >= 0.3""")
def title_block_fuzzy(t):
    return resolution.blocked_pairs(t("part"), "p_partkey", F.concat_ws("/", "p_brand", "p_size"), "p_name", X.similarity, 0.3, (2, 500))


@query("""WITH k AS (SELECT p_partkey AS id, p_brand || '/' || p_type AS block FROM part)
SELECT id, min(id) OVER (PARTITION BY block) AS class_id, count(*) OVER (PARTITION BY block) AS members FROM k WHERE block IS NOT NULL QUALIFY members > 20""")
def title_block_exact_large(t):
    return resolution.large_blocks(t("part"), "p_partkey", F.concat("p_brand", F.lit("/"), "p_type"), 20)


@query("""WITH k AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS block FROM part)
SELECT id, min(id) OVER (PARTITION BY block) AS class_id, count(*) OVER (PARTITION BY block) AS members FROM k WHERE block IS NOT NULL QUALIFY members > 500""")
def title_block_fuzzy_large(t):
    return resolution.large_blocks(t("part"), "p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")), 500)


@query("""WITH k AS (SELECT * FROM part WHERE p_size > 5 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 100), s AS (SELECT a.p_partkey AS id, b.p_partkey AS candidate, 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) AS score FROM part a JOIN k b ON a.p_brand = b.p_brand WHERE a.p_size <= 5)
SELECT id, candidate, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 3""")
def resolve_topk(t):
    part = t("part")
    return resolution.best_candidates(part.where("p_size <= 5"), part.where("p_size > 5"), "p_partkey", "p_brand", "p_name", X.similarity, 0.2, 3)


@query("SELECT min(p_partkey) AS work_id, count(*) AS editions FROM part GROUP BY lower(p_type), p_brand")
def materialize_works(t):
    return resolution.works(t("part"), "p_partkey", [F.lower("p_type"), F.col("p_brand")])


@query("SELECT p_type, min(p_partkey) AS owner_id, count(*) AS claims FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def identifier_owners(t):
    return resolution.first_owner(t("part"), "p_type", "p_partkey")


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]{1,2})$', 1) AS INT) AS volume, CASE WHEN CAST(regexp_extract(p_brand, '([0-9]{1,2})$', 1) AS INT) = p_size THEN 'match' ELSE 'mismatch' END AS relation FROM part""")
def volume_relation(t):
    a, b = X.last_volume(F.col("p_brand")), X.last_volume(F.concat(F.lit("Set "), F.col("p_size").cast("string")))
    return t("part").select("p_partkey", a.alias("volume"), resolution.volume_relation(a, b).alias("relation"))


@query("""WITH e AS (SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS o, levenshtein(lower(p_brand) || substr(p_name, 5), lower(p_type)) AS n FROM part)
SELECT p_partkey, CASE WHEN n < o THEN 'beneficial' WHEN n > o THEN 'harmful' ELSE 'neutral' END AS class FROM e""")
def classify_edits(t):
    after = F.concat(F.lower("p_brand"), F.expr("substr(p_name, 5)"))
    return t("part").select("p_partkey", review.classify_edit(F.lower("p_type"), F.col("p_name"), after).alias("class"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL OR n_chars IS NULL OR toxic IS NULL THEN 'abstain' WHEN n_chars % 4 <= 2 AND n_chars % 100 < 70 AND quality = 1 THEN 'accept' ELSE 'reject' END AS decision
FROM (SELECT d.doc_id, lang, n_chars, toxic, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def gate_decisions(t):
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id", "left")
    agreement = F.when(F.col("toxic").isNotNull() & F.col("lang").isNotNull(), F.col("quality") == 1)
    return rows.select("doc_id", review.gate(F.col("n_chars") % 4, F.col("n_chars") % 100, agreement).alias("decision"))


@query("""SELECT conv_id, count(text) AS votes, CASE WHEN min(text) = max(text) THEN 'agreed' WHEN count(text) = 0 THEN 'no_output' ELSE 'conflict' END AS status, CASE WHEN min(text) = max(text) THEN min(text) END AS text FROM conversations GROUP BY 1""")
def merge_votes(t):
    return review.merged(t("conversations"), "conv_id", "text")


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS k FROM conversations WHERE text IS NOT NULL)
SELECT a.conv_id, count(*) FILTER (WHERE a.turn < b.turn AND a.k > b.k) AS inversions FROM c a JOIN c b ON a.conv_id = b.conv_id GROUP BY 1""")
def reading_order_inversions(t):
    return t("conversations").where("text is not null").groupBy("conv_id").agg(review.inversions("turn", F.char_length("text")).alias("inversions"))


@query(r"""WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS docs FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(*) >= 3""")
def boilerplate_lines(t):
    return review.repeated_lines(t("documents"))


@query("""SELECT 'documents by source' AS "check", (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM documents) AS found, true AS ok
UNION ALL SELECT 'labelled documents', (SELECT count(*) FROM labels), (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)), (SELECT count(*) FROM labels) = (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id))""")
def reconcile_report(t):
    docs, labels = t("documents"), t("labels")
    total = lambda d: d.agg(F.count("*").alias("n"))
    by_source = catalogue.coverage(docs, "source").agg(F.sum("n").alias("n"))
    return review.reconcile(docs.sparkSession, {"documents by source": (total(docs), by_source), "labelled documents": (total(labels), total(labels.join(docs.select("doc_id"), "doc_id", "left_semi")))})


@query("""WITH f AS (SELECT source, avg(quality) - avg(toxic) AS v FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT row_number() OVER (ORDER BY source) - 1 AS pos, v FROM f), n AS (SELECT count(*) AS n, avg(v) AS mean FROM f),
m AS (SELECT i, avg(v) AS m FROM range(10000) r(i), n, unnest(range(n.n)) u(j) JOIN p ON pos = ('0x' || substr(md5('pair:' || i || ':' || j), 1, 8))::BIGINT % n.n GROUP BY 1)
SELECT (SELECT mean FROM n) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m""")
def paired_bootstrap(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").where("source is not null")
    return study.bootstrap(rows.groupBy("source").agg((F.avg("quality") - F.avg("toxic")).alias("v")), "source", "v", seed="pair")


@query("""SELECT n_name, n.c AS ratings FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) n ON n_nationkey = c_nationkey""")
def ratings_with_missing_provider(t):
    rows = t("customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("ratings"))
    return catalogue.with_missing(rows, t("nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_name", "ratings")


@query("""WITH x AS (SELECT user_id, count(*) AS xp FROM events GROUP BY 1) SELECT user_id, xp, CASE WHEN xp >= 100 THEN 3 WHEN xp >= 20 THEN 2 WHEN xp >= 5 THEN 1 ELSE 0 END AS level FROM x""")
def level_of_xp(t):
    xp = t("events").groupBy("user_id").agg(F.count("*").alias("xp"))
    return xp.select("user_id", "xp", F.when(F.col("xp") >= 100, 3).when(F.col("xp") >= 20, 2).when(F.col("xp") >= 5, 1).otherwise(0).alias("level"))


@query()
def overlap_resolution(t):
    """Spans of a user's day by event: from the second of the event on, as long as its id's last digits say."""
    spans = t("events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"), F.col("event_id").alias("id")).withColumn("end", F.col("start") + 3600 + F.col("id") % 86400)
    return review.without_overlaps(spans, "user_id")


STATES = ("view", "click", "purchase", "signup", "error")


@query("""SELECT user_id, s.event_type, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error')) s(event_type)
LEFT JOIN events e USING (user_id, event_type) GROUP BY 1, 2""")
def failure_states_zero_filled(t):
    return study.zero_filled(t("events"), "user_id", "event_type", STATES)


@query("""SELECT doc_id, source, lang, n_chars > 1000 AS long, row_number() OVER (PARTITION BY source, lang, n_chars > 1000 ORDER BY md5('pick:' || doc_id), doc_id) AS pick
FROM documents QUALIFY pick <= 5""")
def stratified_pick(t):
    rows = t("documents").select("doc_id", "source", "lang", (F.col("n_chars") > 1000).alias("long"))
    return study.stratified(rows, ["source", "lang", "long"], "doc_id", 5, "pick")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true)::INT AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return study.sessions(t("events"), "user_id", "ts", "6 hours")


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE quality IS NOT NULL) AS completed, count(*) FILTER (WHERE quality IS NULL) AS remaining,
sum(quality * n_chars)::DOUBLE / sum(CASE WHEN quality IS NOT NULL THEN n_chars END) AS weighted_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def review_progress(t):
    rows = t("documents").select("doc_id", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    seen = F.col("quality").isNotNull()
    weighted = F.try_divide(F.sum(F.col("quality") * F.col("n_chars")).cast("double"), F.sum(F.when(seen, F.col("n_chars"))))
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("completed"), F.count(F.when(~seen, 1)).alias("remaining"), weighted.alias("weighted_quality"))


@query("""SELECT c_custkey, len(list_filter(range(1, least(length(c_name), length(c_mktsegment)) + 1), lambda i: c_name[i] = c_mktsegment[i]))::DOUBLE / greatest(length(c_name), length(c_mktsegment)) AS similarity,
try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number FROM customer""")
def name_similarity(t):
    return t("customer").select("c_custkey", X.positional_similarity(F.col("c_name"), F.col("c_mktsegment")).alias("similarity"), X.first_integer(F.col("c_name")).alias("number"))


@query()
def rows_by_height(t):
    lines, _ = boxes(t("orders"))
    return spatial.rows_by_height(lines, "page", "id")
