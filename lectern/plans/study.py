"""Votes, adjudication, layout and samples over the test tables; importing this module registers the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import relations, spatial, study, voting
from lectern.plans.more import boxes
from lectern.plans.registry import query

VOTERS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
#: An order is a vote of its priority on a region of a page; the last one of a voter counts.
VOTES = """WITH v AS (SELECT o_custkey % 40 AS page, o_orderkey % 5 AS region, o_orderpriority AS voter, arg_max(CASE WHEN o_custkey % 3 = 0 THEN 'same  text' ELSE o_orderstatus END, o_orderkey) AS text, arg_max(CASE WHEN o_totalprice < 20000 THEN 'empty' ELSE 'ok' END, o_orderkey) AS state FROM orders GROUP BY 1, 2, 3),
s AS (SELECT page, region, count(DISTINCT voter) AS n, bool_and(state = 'ok') AS ok, min(regexp_replace(text, '\\s+', ' ', 'g')) AS lo, max(regexp_replace(text, '\\s+', ' ', 'g')) AS hi FROM v WHERE voter IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2),
t AS (SELECT page, region, CASE WHEN n = 3 AND ok AND lo = hi THEN 'provisional_accept' ELSE 'conflict' END AS status, CASE WHEN n = 3 AND ok AND lo = hi THEN lo ELSE '' END AS agreed FROM s),
q AS (SELECT page, region, 'done ' || region AS text, 1 AS revision FROM t WHERE page % 2 = 0)
"""
LABELLED = VOTES + """, w AS (SELECT page, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS voter FROM (SELECT DISTINCT page FROM v)), l AS (SELECT page, voter, substr('ABC', CAST(row_number() OVER (PARTITION BY page ORDER BY md5('blind:' || page || ':' || voter)) AS INT), 1) AS label FROM w)
"""


def votes(t):
    k = F.col("o_orderkey")
    rows = t("orders").select((F.col("o_custkey") % 40).alias("page"), (k % 5).alias("region"), F.col("o_orderpriority").alias("voter"), F.struct(k.alias("k"), F.when(F.col("o_custkey") % 3 == 0, "same  text").otherwise(F.col("o_orderstatus")).alias("text"), F.when(F.col("o_totalprice") < 20000, "empty").otherwise("ok").alias("state")).alias("x"))
    return rows.groupBy("page", "region", "voter").agg(F.max("x").alias("x")).select("page", "region", "voter", "x.text", "x.state")


def resolutions(t):
    return voting.region_status(votes(t), VOTERS).where("page % 2 = 0").select("page", "region", F.concat(F.lit("done "), F.col("region").cast("string")).alias("text"), F.lit(1).alias("revision"))


@query(VOTES + "SELECT * FROM t")
def region_votes(t):
    return voting.region_status(votes(t), VOTERS)


@query(VOTES + "SELECT page, count(*) FILTER (WHERE status = 'provisional_accept') AS provisional_accept, count(*) FILTER (WHERE status = 'conflict') AS conflict, count(*) AS regions FROM t GROUP BY 1")
def page_triage(t):
    return voting.triage(voting.region_status(votes(t), VOTERS))


@query(LABELLED + "SELECT page, label, voter FROM l")
def anonymous_labels(t):
    return voting.labelled(votes(t).select("page").distinct(), VOTERS, "blind")


@query(LABELLED + "SELECT t.page, t.region, label, CASE WHEN state = 'ok' THEN text ELSE '' END AS text, CASE WHEN state = 'ok' THEN 'ok' ELSE 'no_output' END AS state FROM t JOIN l USING (page) LEFT JOIN v ON v.page = t.page AND v.region = t.region AND v.voter = l.voter WHERE status = 'conflict'")
def blind_conflicts(t):
    said = votes(t)
    return voting.blind_conflicts(said, voting.region_status(said, VOTERS), voting.labelled(said.select("page").distinct(), VOTERS, "blind"))


@query(VOTES + "SELECT t.page, count(*) FILTER (WHERE status = 'conflict' AND q.page IS NULL) AS open FROM t LEFT JOIN q USING (page, region) GROUP BY 1")
def open_conflicts(t):
    return voting.open_conflicts(voting.region_status(votes(t), VOTERS), resolutions(t))


@query(VOTES + """, g AS (SELECT page, region, 'new' AS text, page % 3 AS revision FROM t WHERE region < 3), j AS (SELECT coalesce(g.page, q.page) AS page, coalesce(g.region, q.region) AS region, q.text AS ot, q.revision AS old, q.page IS NOT NULL AS had, g.text AS nt, g.revision AS new, coalesce(g.page IS NOT NULL AND coalesce(q.revision, 0) = g.revision, false) AS applied FROM q FULL JOIN g ON q.page = g.page AND q.region = g.region)
SELECT page, region, CASE WHEN applied THEN nt ELSE ot END AS text, CASE WHEN applied THEN new + 1 ELSE old END AS revision, applied FROM j WHERE applied OR had""")
def adjudication(t):
    given = voting.region_status(votes(t), VOTERS).where("region < 3").select("page", "region", F.lit("new").alias("text"), (F.col("page") % 3).alias("revision"))
    return voting.adjudicated(resolutions(t), given)


@query(VOTES + """, j AS (SELECT page, region, '{' || string_agg('"' || voter || '":"' || text || '"', ',' ORDER BY voter) || '}' AS votes FROM v GROUP BY 1, 2) SELECT t.page, t.region, status, votes, q.text AS resolved FROM t JOIN j USING (page, region) LEFT JOIN q USING (page, region)""")
def unblinded_export(t):
    said = votes(t)
    return voting.unblinded(said, voting.region_status(said, VOTERS), resolutions(t))


@query(VOTES + """, a AS (SELECT * FROM v WHERE voter = '1-URGENT'), b AS (SELECT * FROM v WHERE voter = '2-HIGH') SELECT coalesce(a.page, b.page) AS page, coalesce(a.region, b.region) AS region, coalesce(a.text, '') AS a, coalesce(b.text, '') AS b FROM a FULL JOIN b ON a.page = b.page AND a.region = b.region WHERE coalesce(a.text, '') <> coalesce(b.text, '')""")
def submission_conflicts(t):
    return voting.submission_conflicts(votes(t), "1-URGENT", "2-HIGH")


@query(VOTES + "SELECT page, region, coalesce(q.text, agreed) AS text FROM t LEFT JOIN q USING (page, region) WHERE page % 2 = 0 OR status = 'provisional_accept'")
def final_texts(t):
    return voting.final_texts(voting.region_status(votes(t), VOTERS).where("page % 2 = 0 or status = 'provisional_accept'"), resolutions(t))


@query("""SELECT l_orderkey AS page, list_sort(list(CAST(l_linenumber AS BIGINT))) = range(1, count(*) + 1) AS dense, list_sort(list(l_partkey % 3)) = range(count(*)) AS permutation FROM lineitem GROUP BY 1""")
def census_density(t):
    return voting.census_checks(t("lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") - 1).alias("i"), (F.col("l_partkey") % 3).alias("o")), "page", "i", "o")


@query(VOTES + """, k AS (SELECT a.page, a.voter AS a, b.voter AS b, a.text = b.text AS same FROM v a JOIN v b ON a.page = b.page AND a.region = b.region AND a.voter < b.voter WHERE a.state = 'ok' AND b.state = 'ok')
SELECT a, b, count(*) AS regions, round(avg(CAST(same AS DOUBLE)), 4) AS rate FROM k GROUP BY 1, 2""")
def vote_tally(t):
    said = votes(t).where("state = 'ok'")
    return study.agreement_by(said, ["page", "region"], "voter", "text")


# --- Samples


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('11' || chr(0) || o_orderkey), o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey, CASE WHEN r < 40 THEN 'calibration' WHEN r < 140 THEN 'test' WHEN r < 290 THEN 'train' ELSE 'unassigned' END AS split FROM r""")
def quota_splits(t):
    return voting.quota_splits(t("orders"), "o_orderkey", {"train": 150, "test": 100, "calibration": 40}, "11")


@query("""WITH r AS (SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY ('0x' || substr(md5('f9' || p_partkey), 1, 8))::BIGINT, p_partkey) AS r FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2'))
SELECT p_brand, p_partkey, least(1.0::DOUBLE, 4 / n::DOUBLE) AS probability, 'sampled' AS stratum FROM r WHERE r <= 4 UNION ALL SELECT b, k, 1.0::DOUBLE, 'sampled+unprocessed' FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')), range(1, 5) x(k)""")
def family_pages(t):
    part = t("part").select("p_brand", "p_partkey")
    return voting.family_pages(part, part.where("p_brand not in ('Brand#1', 'Brand#2')"), "p_brand", "p_partkey", 4, "f9")


@query("""WITH b AS (SELECT p_partkey, p_size::BIGINT AS n FROM part), c AS (SELECT p_partkey, unnest(CASE WHEN n >= 12 THEN range(3, n - 1) ELSE range(1, n + 1) END) AS page, CASE WHEN n >= 12 THEN n - 4 ELSE n END AS core FROM b)
SELECT p_partkey, page, round(least(1.0::DOUBLE, 10 / core::DOUBLE), 4) AS probability FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ('0x' || substr(md5('pp:' || p_partkey || ':' || page), 1, 8))::BIGINT, page) <= 10""")
def core_pages(t):
    return voting.core_pages(t("part").select("p_partkey", "p_size"), "p_partkey", "p_size", 10, "pp")


@query("""WITH m AS (SELECT o_orderkey, o_totalprice < 20000 AS suspicious, row_number() OVER (PARTITION BY o_totalprice < 20000 ORDER BY ('0x' || substr(md5('mix' || o_orderkey), 1, 8))::BIGINT, o_orderkey) AS r FROM orders), n AS (SELECT count(*) FILTER (WHERE suspicious) AS bad, count(*) FILTER (WHERE NOT suspicious) AS good FROM m),
c AS (SELECT least(bad, 200 - least(good, 200 - least(bad, 100))) AS bad, least(good, 200 - least(bad, 100)) AS good FROM n) SELECT o_orderkey, suspicious FROM m, c WHERE r <= CASE WHEN suspicious THEN bad ELSE good END""")
def mixed_sample(t):
    return voting.mixed_sample(t("orders"), "o_orderkey", F.col("o_totalprice") < 20000, 200, "mix")


@query("""WITH d AS (SELECT doc_id, n_chars // 100 AS n FROM documents QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5('pdf' || doc_id), 1, 8))::BIGINT, doc_id) <= 20)
SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([greatest(0, least(n - 1, floor(n * 0.15)::BIGINT)), greatest(0, least(n - 1, n // 2)), greatest(0, least(n - 1, floor(n * 0.85)::BIGINT))])), ',') END AS pages FROM d""")
def pages_of_sample(t):
    from lectern.functions.text import portable_hash

    docs = t("documents").select("doc_id", F.floor(F.col("n_chars") / 100).alias("n"))
    few = docs.orderBy(portable_hash(F.concat(F.lit("pdf"), F.col("doc_id").cast("string"))), "doc_id").limit(20)
    return few.select("doc_id", F.array_join(F.array_sort(voting.representative_pages(F.col("n"))), ",").alias("pages"))


@query()
def capped_strata(t):
    docs = t("documents").select("doc_id", "source", "lang")
    cells = [["de", "en"], ["en"], ["es", "fr"], ["fr", "es"]]
    return voting.capped_strata(docs, cells, "lang", "doc_id", "source", seed="frame").select("cell", F.col("key").alias("doc_id"))


# --- Layout


@query("""WITH k AS (SELECT o_orderkey AS id, o_custkey % 50 AS page, o_orderstatus AS s, o_orderkey * 37 % 1000 AS x0, o_orderkey * 91 % 1400 AS y0 FROM orders),
w AS (SELECT id, page, x0, y0, x0 + 20 + id % 180 AS x1, y0 + 12 + id % 20 AS y1 FROM k WHERE s <> 'F'), l AS (SELECT id, page, x0, y0, x0 + 100 + id % 400 AS x1, y0 + 60 + id % 300 AS y1 FROM k WHERE s = 'F'),
h AS (SELECT w.id AS word, min(l.id) AS line FROM w JOIN l ON w.page = l.page AND l.x0 < w.x1 AND w.x0 < l.x1 AND l.y0 < w.y1 AND w.y0 < l.y1 GROUP BY 1),
n AS (SELECT w.id AS word, arg_min(l.id, (abs((w.y0 + w.y1) / 2.0::DOUBLE - (l.y0 + l.y1) / 2.0::DOUBLE), l.id)) AS line FROM w JOIN l ON w.page = l.page WHERE w.id NOT IN (SELECT word FROM h) GROUP BY 1) SELECT word, line, true AS hit FROM h UNION ALL SELECT word, line, false FROM n""")
def words_to_lines(t):
    words, lines = boxes(t("orders"))
    return spatial.nearest_lines(words, lines.where("s = 'F'"), "page", "id")


@query("""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3""")
def title_regions(t):
    return relations.top_per_group(t("part"), "p_brand", [F.desc("p_size"), F.col("p_partkey")], 3).select("p_brand", "p_partkey")
