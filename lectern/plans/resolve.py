"""Candidates, reviews, manifests and records over the test tables; importing this module registers the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import candidates
from lectern.plans.registry import query

SIDES = """WITH d AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author, CASE WHEN p_partkey % 5 = 0 THEN 'i' || p_size END AS isbn FROM part WHERE p_size <= 5), e AS (SELECT p_partkey AS edition, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_size % 3 ELSE p_name END AS title, p_brand AS author, CASE WHEN p_partkey % 3 = 0 THEN 'i' || p_size % 7 END AS isbn FROM part WHERE p_size > 5)
"""
VOLUME = "try_cast(nullif(regexp_extract({}, '([0-9]{{1,2}})$', 1), '') AS INT)"


def sides(t):
    part, key, size = t("part"), F.col("p_partkey"), F.col("p_size")
    docs = part.where("p_size <= 5").select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.when(key % 5 == 0, F.concat(F.lit("i"), size.cast("string"))).alias("isbn"))
    said = F.when(size % 2 == 0, F.concat_ws(" ", "p_name", (size % 3).cast("string"))).otherwise(F.col("p_name"))
    return docs, part.where("p_size > 5").select(key.alias("edition"), said.alias("title"), F.col("p_brand").alias("author"), F.when(key % 3 == 0, F.concat(F.lit("i"), (size % 7).cast("string"))).alias("isbn"))


@query(SIDES + """, ip AS (SELECT * FROM e WHERE isbn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY edition) <= 100), i AS (SELECT d.id, ip.edition, 1.0::DOUBLE AS score, 'exact_isbn' AS method FROM d JOIN ip ON d.isbn = ip.isbn),
tp AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY title ORDER BY edition) <= 100), t AS (SELECT d.id, tp.edition, CASE WHEN d.author = tp.author THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score, CASE WHEN d.author = tp.author THEN 'exact_title_author' ELSE 'exact_title' END AS method FROM d JOIN tp ON d.title = tp.title WHERE (d.id, tp.edition) NOT IN (SELECT id, edition FROM i)),
x AS (SELECT * FROM i UNION ALL SELECT * FROM t), pp AS (SELECT *, substr(title, 1, 8) AS pre FROM e QUALIFY row_number() OVER (PARTITION BY substr(title, 1, 8) ORDER BY edition) <= 100), ap AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY author ORDER BY edition) <= 100),
u AS (SELECT id, edition, min(turn) AS turn FROM (SELECT d.id, pp.edition, 0 AS turn FROM d JOIN pp ON substr(d.title, 1, 8) = pp.pre UNION ALL SELECT d.id, ap.edition, 1 FROM d JOIN ap ON d.author = ap.author) WHERE (id, edition) NOT IN (SELECT id, edition FROM x) GROUP BY 1, 2),
c AS (SELECT u.id, u.edition, d.title AS dt, d.author AS da, e.title AS et, e.author AS ea FROM u JOIN d USING (id) JOIN e USING (edition) QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY turn, u.edition) <= 100),
s AS (SELECT id, edition, dt, et, 1 - levenshtein(dt, et)::DOUBLE / greatest(length(dt), length(et)) AS ts, 1 - levenshtein(lower(da), lower(ea))::DOUBLE / greatest(length(da), length(ea)) AS sa FROM c),
f AS (SELECT id, edition, 0.8::DOUBLE * ts + 0.2::DOUBLE * sa - CASE WHEN regexp_matches(et, '[0-9]$') THEN 0.10::DOUBLE ELSE 0 END AS score FROM s WHERE ts >= 0.55 AND sa >= 0.4)
SELECT id, edition, round(score, 9) AS score, method FROM x UNION ALL SELECT id, edition, round(score, 9), 'fuzzy' FROM f WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, edition) <= 10""")
def generated_candidates(t):
    return candidates.generated(*sides(t), title_score=X.similarity, author_score=X.similarity).withColumn("score", F.round("score", 9))


@query()
def scored_candidates(t):
    """All candidates by the scorers that the stages have by default, as pairs of classes and their members."""
    return candidates.all_candidates(*sides(t))


@query(SIDES + """, p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY author ORDER BY edition) <= 5), s AS (SELECT d.id, p.edition AS candidate, 1 - levenshtein(d.title, p.title)::DOUBLE / greatest(length(d.title), length(p.title)) AS ts FROM d JOIN p ON d.author = p.author)
SELECT id, candidate, round(0.6::DOUBLE * ts + 0.4::DOUBLE, 9) AS score FROM s WHERE ts >= 0.55 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(ts, 9) DESC, candidate) = 1""")
def best_matches(t):
    from lectern.operators.relations import pools

    docs, editions = sides(t)
    few = pools(editions, "author", "edition", 5).select(F.col("edition").alias("candidate"), F.col("title").alias("other"), F.col("author").alias("by"))
    pairs = docs.join(few, F.col("author") == F.col("by")).select("id", "candidate", "title", "other")
    return candidates.best_match(pairs, F.round(X.similarity(F.col("title"), F.col("other")), 12), F.lit(1.0)).withColumn("score", F.round("score", 9))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS document, CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'candidate' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'later' END AS decision FROM orders),
w AS (SELECT document, bool_or(status = 'accepted') AS had, min(CASE WHEN status = 'candidate' AND decision = 'accepted' THEN id END) AS winner FROM m GROUP BY 1)
SELECT id, document, CASE WHEN status = 'candidate' AND decision = 'rejected' THEN 'rejected' WHEN status = 'candidate' AND decision = 'accepted' AND NOT had AND id = winner THEN 'accepted' ELSE status END AS status FROM m JOIN w USING (document)""")
def reviewed_matches(t):
    k = F.col("o_orderkey")
    matches = t("orders").select(k.alias("id"), F.col("o_custkey").alias("document"), F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "rejected").otherwise("candidate").alias("status"))
    return candidates.reviewed(matches, t("orders").select(k.alias("id"), F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "rejected").otherwise("later").alias("decision")))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 40 WHEN 1 THEN 35 WHEN 2 THEN 30 ELSE 0 END + CASE WHEN p_size > 10 THEN 30 ELSE 0 END + least(p_retailprice * 20000 / 1e6::DOUBLE, 20) + CASE WHEN p_size > 30 THEN 10 ELSE 0 END AS score FROM part""")
def cover_scores(t):
    size = F.col("p_size")
    source = F.when(size % 4 == 0, "local").when(size % 4 == 1, "publisher").when(size % 4 == 2, "provider").otherwise("none")
    return t("part").select("p_partkey", candidates.cover_score(source, size > 10, F.col("p_retailprice") * 20000, size > 30).alias("score"))


SIGNALS = """WITH s AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE [] END AS a, CASE WHEN p_size % 3 = 0 THEN [p_name, p_type] WHEN p_size % 3 = 1 THEN [p_type] ELSE [] END AS b, CASE WHEN p_size % 5 = 0 THEN [p_type] ELSE [] END AS c FROM part),
n AS (SELECT *, list_concat(list_concat(a, b), c) AS l, CAST(len(a) > 0 AS INT) + CAST(len(b) > 0 AS INT) + CAST(len(c) > 0 AS INT) AS told FROM s),
d AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS every FROM n), t AS (SELECT *, CASE WHEN told <= 1 OR CAST(list_contains(a, every[1]) AS INT) + CAST(list_contains(b, every[1]) AS INT) + CAST(list_contains(c, every[1]) AS INT) >= 2 THEN every[1] END AS title FROM d)
"""


def signals(t):
    size, name, kind = F.col("p_size"), F.col("p_name"), F.col("p_type")
    none = F.array().cast("array<string>")
    return t("part"), [F.when(size % 2 == 0, F.array(name)).otherwise(none), F.when(size % 3 == 0, F.array(name, kind)).when(size % 3 == 1, F.array(kind)).otherwise(none), F.when(size % 5 == 0, F.array(kind)).otherwise(none)]


@query(SIGNALS + "SELECT p_partkey, array_to_string(every, '|') AS names FROM t")
def joined_signals(t):
    part, said = signals(t)
    return part.select("p_partkey", F.array_join(candidates.joined_names(said), "|").alias("names"))


@query(SIGNALS + """SELECT p_partkey, title, array_to_string(CASE WHEN told = 0 THEN [] WHEN told = 1 THEN list_concat(list_concat(a, b), c) WHEN len(list_filter(every, lambda x: (len(a) = 0 OR list_contains(a, x)) AND (len(b) = 0 OR list_contains(b, x)) AND (len(c) = 0 OR list_contains(c, x)))) > 0 THEN every ELSE [] END, '|') AS authors FROM t""")
def accepted_signals(t):
    part, said = signals(t)
    return part.select("p_partkey", candidates.accepted_title(said).alias("title"), F.array_join(candidates.accepted_authors(said), "|").alias("authors"))


@query(SIGNALS + """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'unsupported' WHEN p_size = 2 THEN 'deferred' WHEN p_size = 3 THEN 'unreadable' WHEN p_size = 4 THEN 'not_a_book' WHEN len(every) = 0 THEN 'empty' WHEN title IS NULL THEN 'ambiguous' ELSE 'ok' END AS status FROM t""")
def entry_statuses(t):
    part, said = signals(t)
    size = F.col("p_size")
    return part.select("p_partkey", candidates.entry_status(size != 1, size != 3, size == 2, size != 4, candidates.joined_names(said), candidates.accepted_title(said)).alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 <> 0 THEN 'old' ELSE 'new' END AS made FROM part WHERE p_partkey % 7 <> 0""")
def refreshed_entries(t):
    part = t("part")
    old = part.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.lit("old").alias("made"))
    new = part.where("p_partkey % 7 <> 0").select("p_partkey", F.col("p_size").alias("size"))
    return candidates.refreshed(old, new, "p_partkey", ["size"], lambda rows: rows.withColumn("made", F.lit("new"))).select("p_partkey", "made")


def payloads(t):
    """Records in three shapes."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    google = F.to_json(F.struct(F.struct(F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.col("p_size").alias("pageCount"), (F.col("p_size") / 10).alias("averageRating"), size.alias("ratingsCount")).alias("volumeInfo"), F.lit(" http://x ").alias("url")))
    library = F.to_json(F.struct(F.struct(F.col("p_name").alias("Title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"), F.concat(size, F.lit(" pages")).alias("number_of_pages")).alias("data")))
    shop = F.to_json(F.struct(F.to_json(F.struct(F.lit(" ").alias("Title"), F.col("p_brand").alias("Author"), F.concat(F.lit("p. "), size).alias("Number of Pages"))).alias("specification"), F.col("p_name").alias("name"), size.alias("ratingValue"), F.lit("-3").alias("ratingCount"), F.lit("12").alias("reviewCount"), k.alias("productId")))
    source = F.when(k % 3 == 0, "google_books").when(k % 3 == 1, "open_library").otherwise("rokomari")
    return t("part").select(k.alias("id"), source.alias("source"), F.lit("fallback").alias("title"), F.when(k % 3 == 0, google).when(k % 3 == 1, library).otherwise(shop).alias("raw"))


@query("""SELECT p_partkey AS id, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type ELSE p_brand END AS authors, p_size AS page_count, CASE WHEN p_partkey % 3 = 0 THEN 'http://x' END AS url FROM part""")
def parsed_payloads(t):
    rows = candidates.parsed_records(payloads(t))
    return rows.select("id", "parsed.title", F.array_join("parsed.authors", "|").alias("authors"), "parsed.page_count", "parsed.url")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE ELSE p_size::DOUBLE END AS value, CASE WHEN p_partkey % 3 = 0 THEN p_size::BIGINT END AS rating_count, CASE WHEN p_partkey % 3 = 2 THEN 12::BIGINT END AS review_count FROM part WHERE (p_partkey % 3 = 0 AND p_size <= 50) OR (p_partkey % 3 = 2 AND p_size <= 5)""")
def extracted_ratings(t):
    return candidates.ratings(payloads(t)).select("id", "value", "rating_count", "review_count")


@query("""SELECT p_partkey AS id, p_partkey % 4 <> 0 OR p_size % 2 = 1 AS changed FROM part""")
def rating_changes(t):
    part = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"), F.lit(None).cast("int").alias("n"))
    old = part.where("id % 4 = 0").withColumn("value", F.when(F.col("value") % 2 == 1, F.col("value") + 1).otherwise(F.col("value")))
    return candidates.changed_ratings(old, part, ["id"], ["value", "n"]).select("id", "changed")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'rokomari=e' || p_size ELSE 'rokomari=' || p_partkey END || ';rokomari:product_id=' || p_partkey AS identifiers FROM part WHERE p_partkey % 3 = 2""")
def source_identifiers(t):
    external = F.when(F.col("id") % 2 == 0, F.concat(F.lit("e"), F.col("p_size").cast("string"))).otherwise("line:7")
    rows = payloads(t).where("source = 'rokomari'").join(t("part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    pairs = F.transform(candidates.identifiers(F.col("raw"), external), lambda p: F.concat_ws("=", p["namespace"], p["value"]))
    return rows.select("id", F.array_join(pairs, ";").alias("identifiers"))


MADE = """WITH r AS (SELECT p_partkey AS record, p_name AS title, [p_brand, p_type] AS authors, CASE WHEN p_size % 2 = 0 THEN 'i' || p_size END AS isbn FROM part), w AS (SELECT title, list_sort(authors) AS people, min(record) AS work_id, count(*) AS records FROM r GROUP BY 1, 2),
p AS (SELECT r.*, work_id, coalesce(isbn, 'record:' || record) AS part FROM r JOIN w ON r.title = w.title AND list_sort(r.authors) = people), e AS (SELECT work_id, part, min(record) AS edition_id, min(isbn) AS isbn FROM p GROUP BY 1, 2)
"""


def made(t):
    rows = t("part").select(F.col("p_partkey").alias("record"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("i"), F.col("p_size").cast("string"))).alias("isbn"))
    return candidates.materialized(rows)


@query(MADE + "SELECT e.edition_id, e.work_id, e.isbn, w.records, o.owner_id FROM e JOIN w USING (work_id) LEFT JOIN (SELECT isbn, min(edition_id) AS owner_id FROM e GROUP BY 1) o ON o.isbn = e.isbn")
def materialized_editions(t):
    m = made(t)
    return m["editions"].join(m["works"].select("work_id", "records"), "work_id").join(m["identifiers"], "isbn", "left").select("edition_id", "work_id", "isbn", "records", "owner_id")


@query(MADE + "SELECT edition_id, unnest([0, 1]) AS place, unnest([p_brand, p_type]) AS name FROM e JOIN part ON p_partkey = edition_id")
def materialized_people(t):
    return made(t)["edition_people"]


@query("""WITH x AS (SELECT p_partkey AS edition_id, unnest([0, 1, 2]) AS place, unnest([p_brand, 'Sidebar', p_type]) AS name FROM part), k AS (SELECT * FROM x JOIN part ON p_partkey = edition_id WHERE p_size % 2 = 1 OR name = p_brand)
SELECT edition_id, CAST(row_number() OVER (PARTITION BY edition_id ORDER BY place) - 1 AS INT) AS place, name FROM k""")
def repaired_people(t):
    part = t("part")
    people = part.select(F.col("p_partkey").alias("edition_id"), F.posexplode(F.array("p_brand", F.lit("Sidebar"), "p_type")).alias("place", "name"))
    records = part.select(F.col("p_partkey").alias("record"), F.lit("shop").alias("source"), F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("authors"))
    other = part.select((F.col("p_partkey") + 10**9).alias("record"), F.lit("library").alias("source"), F.array("p_brand").alias("authors"))
    mapped = part.select(F.col("p_partkey").alias("record"), F.col("p_partkey").alias("edition_id")).union(part.select((F.col("p_partkey") + 10**9).alias("record"), F.col("p_partkey").alias("edition_id")))
    return candidates.repaired_people(people, mapped, records.union(other), "shop")


@query("""SELECT n_nationkey, coalesce((SELECT string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS customers, coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation""")
def nested_documents(t):
    rows = candidates.nested(t("nation").select("n_nationkey"), "n_nationkey", {"customers": (t("customer"), "c_nationkey", ["c_custkey", "c_mktsegment"]), "suppliers": (t("supplier"), "s_nationkey", ["s_suppkey"])})
    said = F.transform("customers", lambda c: F.concat_ws(":", c["c_custkey"].cast("string"), c["c_mktsegment"]))
    return rows.select("n_nationkey", F.array_join(said, ",").alias("customers"), F.array_join(F.transform("suppliers", lambda s: s["s_suppkey"].cast("string")), ",").alias("suppliers"))
