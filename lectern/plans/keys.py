"""Keys, names, volumes, identifiers and similarity scores; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import keys as K
from lectern.functions import scorers as S
from lectern.plans.registry import query
from lectern.storage import dealt

#: Longest common subsequence of two short texts, row by row: each cell is the best of the row above up to it.
LCS = """, r AS (SELECT id, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0) AS l FROM p
UNION ALL SELECT id, a, b, i + 1, list_transform(range(length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1), lambda k: greatest(l[k + 1], l[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END))) END) FROM r WHERE i < length(a)),
c AS (SELECT id, a, b, l[len(l)] AS lcs FROM r WHERE i = length(a))
"""


# --- Keys of texts and names


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(translate(regexp_replace(nfc_normalize(text), '[\x{200B}-\x{200D}\x{FEFF}\x{00AD}\x{202A}-\x{202E}]', '', 'g'), '০১২৩৪৫৬৭৮৯', '0123456789')), 'ß', 'ss'), '[^\p{L}\p{N}\x{0980}-\x{09FF}]+', ' ', 'g')) AS key FROM documents""")
def text_keys(t):
    return t("documents").select("doc_id", K.normalize_text("text").alias("key"))


@query(r"""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dr. ' || c_mktsegment || ', Prof ' || c_name || ' (Editor) (2)' WHEN 1 THEN 'Sri Prof. ' || c_name WHEN 2 THEN 'Drake, a, b ' || c_name ELSE 'শ্রী ' || c_name || ' (x)' END AS name FROM customer)
SELECT c_custkey, trim(regexp_replace(lower(CASE c_custkey % 4 WHEN 0 THEN split_part(regexp_replace(name, ' \(Editor\) \(2\)$', ''), ', Prof ', 2) || ' ' || 'dr ' || split_part(substr(name, 5), ',', 1) WHEN 1 THEN substr(name, 11) WHEN 2 THEN name ELSE substr(regexp_replace(name, ' \(x\)$', ''), length('শ্রী ') + 1) END), '[^\p{L}\p{N}\x{0980}-\x{09FF}]+', ' ', 'g')) AS key FROM n""")
def name_keys(t):
    name, m = F.col("c_name"), F.col("c_custkey") % 4
    said = F.when(m == 0, F.concat(F.lit("Dr. "), "c_mktsegment", F.lit(", Prof "), name, F.lit(" (Editor) (2)"))).when(m == 1, F.concat(F.lit("Sri Prof. "), name)).when(m == 2, F.concat(F.lit("Drake, a, b "), name)).otherwise(F.concat(F.lit("শ্রী "), name, F.lit(" (x)")))
    return t("customer").select("c_custkey", K.normalize_name(said).alias("key"))


@query("""SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' é' WHEN 1 THEN ' é' ELSE ' বই Ã' END AS title FROM part""")
def mojibake_repair(t):
    m = F.col("p_partkey") % 3
    said = F.concat("p_name", F.when(m == 0, " Ã©").when(m == 1, " é").otherwise(" বই Ã"))
    return t("part").select("p_partkey", K.repair_mojibake(said).alias("title"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' নববসসসজ' ELSE ' ববনন' END AS key FROM part""")
def folded_titles(t):
    said = F.concat(F.upper("p_name"), F.when(F.col("p_size") % 2 == 0, "-ণরভশষসিয").otherwise("-বীরূ নৌণা"))
    return t("part").select("p_partkey", F.regexp_replace(K.fold_bengali(said), "(?<=বব) ", "").alias("key"))


@query("""SELECT p_partkey, 'রচনা ' || p_name AS title, lower('রচনা ' || p_name) AS sort_key FROM part""")
def sort_titles(t):
    said = F.concat(F.lit("শ্রী  রচনা় "), F.initcap("p_name"))
    return t("part").select("p_partkey", F.concat(F.lit("রচনা "), F.substring(F.lower(K.normalize_bengali(said)), 6, 1000)).alias("title"), K.title_sort_key(said).alias("sort_key"))


@query(r"""SELECT doc_id, text AS raw, nfc_normalize(text) AS strict, trim(regexp_replace(translate(nfc_normalize(text), '‘’“”', '''''""'), '\s+', ' ', 'g')) AS search FROM documents""")
def text_policies(t):
    return t("documents").select("doc_id", *[K.policy_view(F.col("text"), p).alias(n) for p, n in (("raw", "raw"), ("nfc_strict", "strict"), ("nfc_search", "search"))])


@query(r"""SELECT item_id, trim(regexp_replace(translate(nfc_normalize(text || ' ‘a’  “b”'), '‘’', ''''''), '\s+', ' ', 'g')) AS said FROM benchmark""")
def benchmark_normal(t):
    return t("benchmark").select("item_id", K.benchmark_view(F.concat("text", F.lit(" ‘a’  “b”"))).alias("said"))


@query("SELECT doc_id, length_grapheme(text) AS clusters FROM documents")
def grapheme_counts(t):
    return t("documents").select("doc_id", F.size(K.graphemes(F.col("text"))).alias("clusters"))


@query(r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS said FROM documents""")
def shingle_views(t):
    return t("documents").select("doc_id", K.shingle_view(F.col("text")).alias("said"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '\s+([।,;:!?])', '\1', 'g'), '\s+', ' ', 'g')) AS line FROM documents""")
def clean_lines(t):
    return t("documents").select("doc_id", K.clean_line(F.col("text")).alias("line"))


@query(r"""SELECT doc_id, trim(trim(regexp_replace(text, '\s+', ' ', 'g')), chr(9) || chr(160) || ' -_–—:;,.') AS said FROM documents""")
def tidy_texts(t):
    return t("documents").select("doc_id", K.tidy(F.col("text")).alias("said"))


@query(r"""WITH t AS (SELECT item_id, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS k, unnest(regexp_extract_all(text, '\s*\S+')) AS piece FROM benchmark)
SELECT item_id, k, trim(piece, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS token, CAST(sum(length(piece)) OVER (PARTITION BY item_id ORDER BY k) AS BIGINT) AS stop FROM t""")
def token_spans(t):
    from lectern.operators.review import token_spans as spans

    return spans(t("benchmark"), "item_id", "text").select("item_id", "k", "token", "stop")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '7,' || p_size WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '2' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE '' END AS volumes FROM part WHERE p_size > 9""")
def volume_sets(t):
    m, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    said = F.when(m == 0, F.concat(F.lit("Vol. "), size, F.lit(" of part-07"))).when(m == 1, F.concat("p_name", F.lit("-0"), size)).when(m == 2, F.concat("p_name", F.lit(" দ্বিতীয় x"))).when(m == 3, F.concat(F.lit("খণ্ড-"), F.translate(size, K.DIGITS, K.BENGALI_DIGITS))).otherwise(F.col("p_name"))
    rows = t("part").where("p_size > 9").select("p_partkey", K.volume_tokens(F.concat(said, F.lit(".pdf"))).alias("v"))
    return rows.select("p_partkey", F.array_join(F.reverse("v"), ",").alias("volumes"))


@query("""SELECT p_partkey, p_size % 3 <> p_partkey % 3 AS conflict FROM part""")
def volume_vetoes(t):
    name = lambda n: F.concat("p_name", F.lit("-0"), (n % 3).cast("string"), F.lit(".pdf"))
    return dealt(t("part").select("p_partkey", "p_name", "p_size")).select("p_partkey", K.volume_conflict(name(F.col("p_size")), name(F.col("p_partkey"))).alias("conflict"))


@query(r"""WITH f AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'Untitled-' || p_size WHEN 2 THEN p_brand || '.pdf' WHEN 3 THEN CAST(p_size AS VARCHAR) || ' - 12' WHEN 4 THEN 'a/b' ELSE 'Microsoft Word - x' END AS title FROM part)
SELECT p_partkey, p_partkey % 6 <> 0 AS junk, p_partkey % 6 IN (3) AS junk_author FROM f""")
def junk_titles(t):
    m, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    title = F.when(m == 0, F.col("p_name")).when(m == 1, F.concat(F.lit("Untitled-"), size)).when(m == 2, F.concat("p_brand", F.lit(".pdf"))).when(m == 3, F.concat(size, F.lit(" - 12"))).when(m == 4, "a/b").otherwise("Microsoft Word - x")
    return t("part").select("p_partkey", K.junk_title(title, F.lit("scan 7.pdf")).alias("junk"), K.junk_author(title).alias("junk_author"))


@query("""SELECT p_partkey, p_name || '|' || p_type || ', ' || p_brand || '|x|y z|' || p_size || ' q' AS authors FROM part""")
def authors_split(t):
    said = F.concat("p_name", F.lit(" AND "), "p_type", F.lit(", "), "p_brand", F.lit("; x,  y   z, unknown, 123; ; "), F.col("p_size").cast("string"), F.lit(" q"))
    return t("part").select("p_partkey", F.array_join(K.split_authors(said), "|").alias("authors"))


@query(r"""SELECT p_partkey, '978-0-306-40615-' || p_partkey % 10 || '|' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'X' AS found FROM part""")
def isbn_spans(t):
    last = (F.col("p_partkey") % 10).cast("string")
    said = F.concat(F.lit("isbn 978-0-306-40615-"), last, F.lit(", and 12345 or "), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("X."))
    return t("part").select("p_partkey", F.array_join(K.isbn_candidates(said), "|").alias("found"))


@query("""WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS b FROM part),
c AS (SELECT p_partkey, b, CAST((11 - list_sum(list_transform(range(1, 10), lambda i: (11 - i) * CAST(substr(b, CAST(i AS INT), 1) AS INT))) % 11) % 11 AS INT) AS s FROM d)
SELECT p_partkey, CASE WHEN s = p_partkey % 11 THEN b || CASE WHEN s = 10 THEN 'X' ELSE CAST(s AS VARCHAR) END END AS isbn10 FROM c""")
def isbn10_canonical(t):
    body, last = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0"), F.col("p_partkey") % 11
    said = F.concat(F.substring(body, 1, 4), F.lit("-"), F.substring(body, 5, 5), F.lit(" "), F.when(last == 10, "x").otherwise(last.cast("string")))
    return t("part").select("p_partkey", K.canonical_isbn10(said).alias("isbn10"))


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 3) AS person FROM customer""")
def person_names(t):
    m = F.col("c_custkey") % 4
    said = F.when(m == 0, F.concat("c_name", F.lit(" Khan"))).when(m == 1, F.concat("c_mktsegment", F.lit(" Series"))).when(m == 2, F.lit("epub-staging")).otherwise(F.lit("রহিম"))
    return t("customer").select("c_custkey", K.person_name(said).alias("person"))


@query("""SELECT page_id, split_part(url, '/', 3) AS author, regexp_replace(regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '\\.[^.]*$', ''), '\\s*[-–—]\\s*[^-–—]+$', '') AS title FROM pages""")
def path_parts(t):
    path = F.concat(F.lit("data/"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    return t("pages").select("page_id", K.path_author(F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("\\x - y.pdf"))).alias("author"), K.path_title(path).alias("title"))


@query("""SELECT page_id, replace(replace(url, 'utm_source', '[redacted]'), 'example', '[redacted-host]') AS url FROM pages""")
def redacted_urls(t):
    return t("pages").select("page_id", K.redacted(F.col("url"), ["utm_source", "https://example/x", ""]).alias("url"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([0, 1, floor(n * 0.25)::BIGINT, floor(n * 0.5)::BIGINT, floor(n * 0.75)::BIGINT], lambda x: x < n))), ',') AS pages FROM (SELECT doc_id, n_chars // 1000 AS n FROM documents)""")
def sampled_pages(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(K.page_indexes(F.floor(F.col("n_chars") / 1000))), ",").alias("pages"))


# --- Scores


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name AS a, lower(p_type) AS b FROM part)""" + LCS + "SELECT id, 200.0::DOUBLE * lcs / (length(a) + length(b)) AS score FROM c")
def fuzz_ratios(t):
    return t("part").select(F.col("p_partkey").alias("id"), S.fuzz_ratio(F.col("p_name"), F.lower("p_type")).alias("score"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, array_to_string(list_sort(string_split(p_name || ' ' || lower(p_type), ' ')), ' ') AS a, array_to_string(list_sort(string_split('big ' || p_name, ' ')), ' ') AS b FROM part)""" + LCS + "SELECT id, 200.0::DOUBLE * lcs / (length(a) + length(b)) AS score FROM c")
def token_sort_ratios(t):
    return t("part").select(F.col("p_partkey").alias("id"), S.fuzz_token_sort(F.concat_ws(" ", "p_name", F.lower("p_type")), F.concat(F.lit("big "), "p_name")).alias("score"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS key, split_part(p_name, ' ', 2) AS s, lower(p_type) || p_brand AS l FROM part), x AS (SELECT key, s, l, unnest(range(1 - length(s), length(l))) AS i FROM w WHERE length(s) <= length(l)),
q AS (SELECT DISTINCT s, substr(l, CAST(greatest(0, i) + 1 AS INT), CAST(length(s) + least(i, 0) AS INT)) AS part FROM x), p AS (SELECT row_number() OVER () AS id, s AS a, part AS b FROM q)""" + LCS
       + """, best AS (SELECT a, b, 200.0::DOUBLE * lcs / (length(a) + length(b)) AS v FROM c) SELECT key AS id, max(v) AS score FROM x JOIN best ON a = s AND b = substr(l, CAST(greatest(0, i) + 1 AS INT), CAST(length(s) + least(i, 0) AS INT)) GROUP BY 1""")
def partial_ratios(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("a"), F.concat(F.lower("p_type"), "p_brand").alias("b"))
    return rows.select("id", S.fuzz_partial("a", "b").alias("score"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part""")
def token_set_ratios(t):
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_brand", "p_name", F.lit("more"))).otherwise(F.lit("012345"))
    return t("part").select(F.col("p_partkey").alias("id"), S.fuzz_token_set(F.col("p_name"), other).alias("score"))


@query()
def title_scores(t):
    return t("part").select("p_partkey", S.title_score(F.col("p_name"), F.concat_ws(" ", F.lower("p_type"), "p_name")).alias("title"), S.match_score(F.col("p_name"), F.lower("p_type")).alias("match"))


@query()
def difflib_ratios(t):
    return t("part").select("p_partkey", S.difflib_ratio(F.col("p_name"), F.lower("p_type")).alias("score"))


@query("""SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS edits, length(lower(p_type)) - length(p_name) AS growth FROM part""")
def edit_operations(t):
    ops = S.edit_operations(F.col("p_name"), F.lower("p_type"))
    return t("part").select("p_partkey", ops.alias("o")).select("p_partkey", F.when(F.col("o.edits") == F.col("o.inserts") + F.col("o.deletes") + F.col("o.replaces"), F.col("o.edits")).cast("long").alias("edits"), (F.col("o.inserts") - F.col("o.deletes")).cast("long").alias("growth"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS a, string_split('red ' || p_name || ' bolt', ' ') AS b FROM part), d AS (SELECT p_partkey, a, b, list_distinct(a || b) AS u FROM w)
SELECT p_partkey, levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(64 + list_position(u, x) AS INT))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(64 + list_position(u, x) AS INT))), '')) AS edits FROM d""")
def word_distances(t):
    a, b = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "), F.split(F.concat(F.lit("red "), "p_name", F.lit(" bolt")), " ")
    return t("part").select("p_partkey", S.sequence_distance(a, b).cast("long").alias("edits"))


@query("""SELECT p_partkey, levenshtein(p_name, lower(p_type))::DOUBLE / length(p_name) AS ger FROM part""")
def grapheme_error_rates(t):
    accent = F.lit("é")  # two code points, one cluster
    return t("part").select("p_partkey", (S.grapheme_distance(F.concat("p_name", accent), F.concat(F.lower("p_type"), accent)) / F.char_length("p_name")).alias("ger"))


# --- File names


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || '|' || p_type || '~' WHEN 1 THEN p_name || '~' || p_brand WHEN 2 THEN p_name || '~' || p_brand || ' x' WHEN 3 THEN p_name || '~' WHEN 4 THEN '~' ELSE p_name || '~' || p_type || ' y|' || p_brand || ' z' END AS found,
CASE WHEN p_partkey % 6 = 3 THEN CAST(p_size AS VARCHAR) END AS volume, CASE WHEN p_partkey % 6 = 3 THEN '1989' END AS year, p_partkey % 6 = 4 AS is_not_a_book FROM part""")
def parsed_filenames(t):
    from lectern.functions import filenames

    m, name, kind, brand, size = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string")
    at = lambda source, *parts: F.concat(F.lit(f"data/incoming-scraped/{source}/books/"), *parts, F.lit(".pdf"))
    path = (F.when(m == 0, at("granthagara", name, F.lit(" বাংলা বই পিডিএফ ডাউনলোড_ "), kind, F.lit(" Bengali Book PDF Download"))).when(m == 1, at("amarboi", brand, F.lit(" - "), name))
            .when(m == 2, at("allbanglaboi", name, F.lit(" by "), brand, F.lit(" x"))).when(m == 3, at("books", name, F.lit(" [Pt. "), size, F.lit("] [1989]"))).when(m == 4, at("books", F.lit("Chapter "), size))
            .otherwise(F.concat(F.lit("shelf/"), brand, F.lit(" z/"), name, F.lit(" - "), kind, F.lit(" y.pdf"))))
    rows = t("part").select("p_partkey", filenames.parsed_path(path).alias("f"))
    return rows.select("p_partkey", F.concat(F.array_join("f.titles", "|"), F.lit("~"), F.array_join("f.authors", "|")).alias("found"), "f.volume", "f.year", "f.is_not_a_book")


@query("""SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 < 2 THEN p_brand || ' Khan' END AS author, CASE WHEN p_partkey % 3 < 2 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM part""")
def embedded_titles(t):
    from lectern.functions import filenames

    m = F.col("p_partkey") % 3
    said = F.when(m == 0, F.concat("p_name", F.lit(" By "), "p_brand", F.lit(" Khan.pdf"))).when(m == 1, F.concat(F.lit("Unknown Author - "), "p_name", F.lit(" ।। "), "p_brand", F.lit(" Khan ( Site.com ).epub"))).otherwise(F.concat("p_name", F.lit(" ( PDFDrive.com ).epub")))
    rows = t("part").select("p_partkey", filenames.parsed_title(said).alias("f"))
    return rows.select("p_partkey", F.try_element_at("f.titles", F.lit(1)).alias("title"), F.try_element_at("f.authors", F.lit(1)).alias("author"), "f.confidence")
