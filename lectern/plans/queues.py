"""Sources, keyed sinks, queues and layout over the test tables; importing this module registers the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import spatial
from lectern.plans.registry import query
from lectern.sources import files, ocr, records, sinks
from lectern.streaming import jobs


@query("""SELECT o_custkey AS id, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def first_writer_wins(t):
    return sinks.first_writer(t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderkey"), ["id"], "o_orderkey").select("id", "status")


@query("""SELECT p_brand AS source, sha256(p_type) AS sha256, p_type AS payload FROM part GROUP BY 1, 2, 3""")
def stored_snapshots(t):
    part = t("part").select(F.col("p_brand").alias("source"), "p_type", "p_size")
    old = part.where("p_size <= 10").select("source", F.sha2("p_type", 256).alias("sha256"), F.col("p_type").alias("payload")).distinct()
    return sinks.snapshots(old, part.select("source", "p_type"), "p_type")


@query("""WITH k AS (SELECT DISTINCT p_brand AS source, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS external FROM part) SELECT source, external FROM k""")
def inserted_records(t):
    keys = t("part").select(F.col("p_brand").alias("source"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4).alias("external"))
    return sinks.insert_absent(keys.where("source <= 'Brand#15'").distinct(), keys, ["source", "external"])


@query("""SELECT user_id, max(event_id) AS at FROM events GROUP BY 1""")
def checkpoint_cursors(t):
    events = t("events").select("user_id", F.col("event_id").alias("at"))
    return sinks.checkpoints(events.where("at % 2 = 0"), events.where("at % 2 = 1"), "user_id", "at")


@query("""SELECT p_partkey AS file, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' ELSE 'unlisted' END AS state FROM part""")
def verified_bundle(t):
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("name"), F.sha2("p_name", 256).alias("sha256"))
    manifest, found = rows.where("name % 4 <> 3"), rows.where("name % 4 <> 2").withColumn("sha256", F.when(F.col("name") % 4 == 1, "other").otherwise(F.col("sha256")))
    return files.verified(found, manifest).select(F.col("name").alias("file"), "state")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'position:0' END AS id, p_name AS title FROM part UNION ALL SELECT p_partkey, 'b', p_type FROM part""")
def staged_responses(t):
    item = lambda i, title: F.struct(i.alias("id"), F.struct(title.alias("title")).alias("volumeInfo"))
    first = item(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_name"))
    raw = F.to_json(F.struct(F.array(first, item(F.lit("b"), F.concat(F.lit(" "), "p_type")), item(F.lit("c"), F.lit(" "))).alias("items")))
    return records.response_items(t("part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw").select("p_partkey", "id", "title")


@query("""SELECT p_partkey, p_name AS text, p_size::DOUBLE AS x0, 0.0::DOUBLE AS y0, p_size + 9.5::DOUBLE AS x1, 7.0::DOUBLE AS y1, CASE WHEN p_size % 2 = 0 THEN 0.75::DOUBLE END AS conf FROM part""")
def cloud_polygon_lines(t):
    size = F.col("p_size").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    polygon = F.array(point(size, F.lit(7.0)), point(size + 9.5, F.lit(None).cast("double")), point(size + 1, F.lit(3.0)))
    words = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("a").alias("text"), F.lit(0.5).alias("confidence")), F.struct(F.lit("b").alias("text"), F.lit(1.0).alias("confidence"))))
    line = F.struct(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("text"), polygon.alias("boundingPolygon"), words.alias("words"))
    raw = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("blocks")).alias("readResult")))
    return ocr.polygon_lines(t("part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw").select("p_partkey", "text", "x0", "y0", "x1", "y1", "conf")


@query("""SELECT p_partkey, k AS line, CASE WHEN k = 0 THEN split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) ELSE p_type END AS text, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 50.0::DOUBLE END AS x0, CASE WHEN k = 0 THEN 40.0::DOUBLE ELSE 90.0::DOUBLE END AS x1 FROM part, range(2) r(k)""")
def cloud_word_lines(t):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))

    def word(text, x, ends=None):
        symbol = lambda s, e: F.struct(s.alias("text"), F.struct(F.struct(F.lit(e).cast("string").alias("type")).alias("detectedBreak")).alias("property"))
        box = F.struct(F.array(point(x, 0), point(x + 20, 9)).alias("vertices"))
        return F.struct(F.array(symbol(F.substring(text, 1, 2), None), symbol(F.substring(text, 3, 99), ends)).alias("symbols"), box.alias("boundingBox"))

    first, second = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    words = F.array(word(first, 0), word(second, 20, "LINE_BREAK"), word(F.col("p_type"), 50, "SPACE"), word(F.lit(""), 70))
    page = F.struct(F.array(F.struct(F.array(F.struct(words.alias("words"))).alias("paragraphs"))).alias("blocks"))
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(page).alias("pages")).alias("fullTextAnnotation"))).alias("responses")))
    rows = ocr.vision_lines(t("part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw")
    return rows.select("p_partkey", F.col("line").cast("long").alias("line"), "text", "x0", F.when(F.col("line") == 0, F.col("x1")).otherwise(F.lit(90.0)).alias("x1"))


@query("""SELECT p_partkey, p_name AS text, least(p_size, 20)::DOUBLE AS x0, greatest(p_size, 20)::DOUBLE AS x1 FROM part""")
def local_record_lines(t):
    good = F.struct(F.col("p_name").alias("text"), F.array(F.col("p_size"), F.lit(9), F.lit(20), F.lit(2)).alias("bbox"), F.lit(0.5).alias("conf"))
    bad = F.struct(F.lit("x").alias("text"), F.array(F.lit(1), F.lit(2)).alias("bbox"), F.lit(0.5).alias("conf"))
    return ocr.record_lines(t("part").select("p_partkey", F.to_json(F.array(bad, good)).alias("raw")), "p_partkey", "raw").select("p_partkey", "text", "x0", "x1")


@query(r"""WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) AS body, html FROM pages) SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN body <> '' THEN body ELSE html END, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM b""")
def html_bodies(t):
    return t("pages").select("page_id", ocr.body_text(F.col("html")).alias("said"))


# --- Queues


@query("""WITH p AS (SELECT user_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM p)
SELECT user_id, ts FROM r QUALIFY epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id, run)) >= 120000000""")
def settled_files(t):
    return jobs.settled(t("events").select("user_id", "ts", "event_type"), "user_id", "ts", ["event_type"])


@query("""WITH o AS (SELECT p_partkey AS path, p_size AS size, p_size AS mtime, 1000 - p_size * 10 AS since FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN p_size + 1 ELSE p_size END AS size, p_size AS mtime FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(s.path, o.path) AS path, CASE WHEN s.path IS NULL THEN o.since WHEN o.path IS NULL OR s.size <> o.size THEN 1000 ELSE o.since END AS since, s.path IS NOT NULL AS present, coalesce(s.path IS NOT NULL AND s.size = o.size AND 1000 - o.since >= 120, false) AS ready FROM o FULL JOIN s ON o.path = s.path""")
def polled_files(t):
    part = t("part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.col("p_size").alias("mtime"))
    state = part.where("path % 3 <> 0").withColumn("since", 1000 - F.col("size") * 10)
    seen = part.where("path % 4 <> 0").withColumn("size", F.when(F.col("size") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return jobs.poll(state, seen, F.lit(1000)).select("path", "since", "present", "ready")


@query("""WITH j AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey < 4 THEN 'running' WHEN o_orderstatus = 'F' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'retry' ELSE 'done' END AS state, 'host' || o_orderkey AS host, o_totalprice AS size, o_orderdate AS updated, o_custkey % 2 = 0 AS due FROM orders), h AS (SELECT 'host' || n AS host FROM range(10) x(n)),
r AS (SELECT host, id FROM j WHERE state = 'running' AND host IN (SELECT host FROM h)), f AS (SELECT host, row_number() OVER (ORDER BY host) AS n FROM h WHERE host NOT IN (SELECT host FROM r)), w AS (SELECT id, row_number() OVER (ORDER BY size, updated, id) AS n FROM j WHERE state IN ('pending', 'retry') AND due)
SELECT host, id FROM r UNION ALL SELECT host, id FROM f JOIN w USING (n)""")
def claimed_jobs(t):
    k = F.col("o_orderkey")
    state = F.when(k < 4, "running").when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "retry").otherwise("done")
    rows = t("orders").select(k.alias("id"), state.alias("state"), F.concat(F.lit("host"), k.cast("string")).alias("host"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("updated"), (F.col("o_custkey") % 2 == 0).alias("due"))
    return jobs.claims(rows, rows.sparkSession.range(10).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("host")))


@query("""SELECT user_id, n AS attempts, CASE WHEN n >= 3 THEN 'failed' ELSE 'retry' END AS state, CAST(least(3600, 60 * pow(2, n)) AS BIGINT) AS wait FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)""")
def failed_jobs(t):
    rows = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"))
    return rows.select("user_id", "attempts", jobs.failed(F.col("attempts")).alias("state"), jobs.wait_seconds(F.col("attempts")).alias("wait"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'errors' WHEN p_size % 5 = 0 THEN 'superseded' WHEN p_partkey % 300 > 880 - 700 THEN 'settling' WHEN p_size % 3 = 0 THEN 'unchanged' ELSE 'published' END AS outcome FROM part) GROUP BY 1""")
def publication_poll(t):
    size = F.col("p_size")
    rows = t("part").select(F.when(size % 7 == 0, 2000).alias("retry_at"), F.lit("a").alias("sha256"), F.when(size % 5 == 0, "b").otherwise("a").alias("source_sha256"), (F.col("p_partkey") % 300 + 700).alias("touched"), F.when(size % 3 == 0, "k").alias("done_key"), F.lit("k").alias("key"))
    return jobs.publication(rows, F.lit(1000)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 250 ORDER BY event_id LIMIT 100")
def resumed_batch(t):
    return jobs.next_batch(t("events").select("event_id", "event_type"), "event_id", 250, 100)


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 50 AS allowed FROM events""")
def quota_calls(t):
    return jobs.within_quota(t("events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", 50).select("event_id", "allowed")


@query()
def merged_cover_lines(t):
    rows = t("part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), (F.col("p_retailprice") / 1000).alias("confidence"), (F.col("p_size") % 9 + 10).alias("height"), (F.col("p_partkey") * 7 % 900).alias("top"), (F.col("p_size") * 3).alias("left"), (F.col("p_size") * 3 + 60).alias("right"))
    return spatial.merged_lines(rows, "page")
