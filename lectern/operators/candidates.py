"""Resolution of documents to editions: staged candidates, best matches, reviews; and records made into works."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import keys, scorers
from lectern.operators.relations import pools
from lectern.operators.resolution import volume_relation
from lectern.storage import broadcast_within, cut, dealt

#: Editions of a pool, candidates that are kept, characters of a prefix, and the least scores.
POOL, KEPT, PREFIX = 100, 10, 8
#: Documents of one kind that meet its candidates in one part, and rows of either side of a key that meet in one.
MEMBERS, BLOCK = 1024, 64
LEAST_TITLE, LEAST_AUTHOR, LEAST_SCORE = 0.55, 0.4, 0.55


def _fuzzy(pool: DataFrame, title_score, author_score) -> DataFrame:
    """``pool`` (d_title, d_author, e_title, e_author) with ``score``, without the pairs that are no candidates."""
    both = F.col("d_author").isNotNull() & F.col("e_author").isNotNull()
    scored = pool.withColumns({"t": title_score(F.lower("d_title"), F.lower("e_title")), "a": F.when(both, author_score(F.lower("d_author"), F.lower("e_author"))).otherwise(0.0)})
    volume = volume_relation(keys.volume_number(F.col("d_title")), keys.volume_number(F.col("e_title")))
    less = F.when(volume == "mismatch", 0.25).when(volume == "missing", 0.10).otherwise(0.0)
    return scored.withColumn("score", 0.8 * F.col("t") + 0.2 * F.col("a") - less).where((F.col("t") >= LEAST_TITLE) & (~both | (F.col("a") >= LEAST_AUTHOR)) & (F.col("score") >= LEAST_SCORE))


def generated(docs: DataFrame, editions: DataFrame, title_score=scorers.title_score, author_score=scorers.match_score) -> DataFrame:
    """(id, edition, score, method): candidates of documents (id, title, author, isbn) among editions (edition, title, author,
    isbn), in stages: the same ISBN scores 1; the same title 1 with the same author, else 0.8; of the others, those of the
    first 100 by id whose title shares its first 8 characters, then those of the author, score 0.8 by title and 0.2 by
    author, less 0.25 for another volume and 0.10 where only one has a volume. Titles below 0.55, authors below 0.4 and
    scores below 0.55 are no candidates; the ten best stay, ties to the smaller edition.

    Pools are cut by id inside the prefix and the author before anything is scored, so a prefix or an author with very
    many editions gives 100 rows to each document; ``all_candidates`` has no such cuts. Null keys meet nothing.

    Documents equal in title, author and ISBN are one kind, with the same candidates: the stages run once a kind, by its
    smallest id, and the documents take what they find. A kind's documents are dealt over parts of about MEMBERS.
    """
    held = docs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("title", "author", "isbn"))).alias("rows"))
    kinds = held.groupBy("rows").agg(F.min("id").alias("kind"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    d = kinds.select(F.col("kind").alias("id"), F.inline("rows")).select("id", F.col("title").alias("d_title"), F.col("author").alias("d_author"), F.col("isbn").alias("d_isbn"), F.lower("title").alias("d_key"))
    e = editions.select("edition", F.col("title").alias("e_title"), F.col("author").alias("e_author"), F.col("isbn").alias("e_isbn"), F.lower("title").alias("e_key"))
    same_author = F.coalesce(F.lower("d_author") == F.lower("e_author"), F.lit(False))
    by_isbn = d.join(pools(e.where("e_isbn is not null"), "e_isbn", "edition", POOL), F.col("d_isbn") == F.col("e_isbn")).select("id", "edition", F.lit(1.0).alias("score"), F.lit("exact_isbn").alias("method"))
    titled = d.join(pools(e, "e_key", "edition", POOL), F.col("d_key") == F.col("e_key"))
    by_title = titled.select("id", "edition", F.when(same_author, 1.0).otherwise(0.8).alias("score"), F.when(same_author, "exact_title_author").otherwise("exact_title").alias("method")).join(by_isbn, ["id", "edition"], "left_anti")
    exact = by_isbn.union(by_title)
    prefix = pools(e.withColumn("e_prefix", F.substring("e_key", 1, PREFIX)), "e_prefix", "edition", POOL)
    near = d.join(prefix, F.substring("d_key", 1, PREFIX) == F.col("e_prefix")).drop("e_prefix").withColumn("turn", F.lit(0))
    named = d.join(pools(e.where("e_author is not null"), "e_author", "edition", POOL), F.col("d_author") == F.col("e_author")).withColumn("turn", F.lit(1))
    words = ["d_title", "d_author", "e_title", "e_author"]
    taken = exact.select("id", "edition", *[F.lit(None).cast("string").alias(w) for w in words], F.lit(-1).alias("turn"))
    # all of a document's rows are dealt once, by id; pairs that an exact stage has are known by their turn
    every = dealt(near.select("id", "edition", *words, "turn").unionByName(named.select("id", "edition", *words, "turn")).unionByName(taken), "id")
    pool = every.withColumn("first", F.min("turn").over(Window.partitionBy("id", "edition"))).where("first >= 0").groupBy("id", "edition", *words).agg(F.min("turn").alias("turn"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("turn", "edition"))
    pool = pool.withColumn("_r", rank).where(F.col("_r") <= POOL).drop("_r")
    fuzzy = _fuzzy(pool, title_score, author_score)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "edition"))
    top = fuzzy.withColumn("_r", best).where(F.col("_r") <= KEPT).select("id", "edition", "score", F.lit("fuzzy").alias("method"))
    dealing = kinds.select(F.col("kind").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = exact.union(top).join(dealing, F.col("id").eqNullSafe(F.col("of"))).drop("id")  # null-safe: a null id has candidates, too
    members = held.join(kinds, "rows").select("id", "kind", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("turn"))
    return members.join(found, F.col("kind").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("part"))).select("id", "edition", "score", "method")


def _classes(rows: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, of): the class of each ``key`` by its different values of ``fields``, named after its smallest key; and (of, *fields),
    the values of each class."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("rows"))
    named = cut(held.groupBy("rows").agg(F.min(key).alias("of")))
    return held.join(broadcast_within(named), "rows").select(key, "of"), named.select("of", F.inline("rows"))


def _meetings(left: DataFrame, right: DataFrame, a: str, b: str, block: int) -> DataFrame:
    """All pairs of rows with equal ``a`` and ``b``; null meets nothing. A value's rows are dealt over parts of about ``block`` on
    either side and every two parts meet on their own, so a common value is spread over tasks."""
    parts = lambda rows, k, n: rows.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.ceil(F.count("*") / block).cast("long").alias(n))
    shared = cut(parts(left, a, "_m").join(parts(right, b, "_n"), "_k"))
    few = broadcast_within(shared)

    def side(rows: DataFrame, k: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        placed = rows.join(few, F.col(k) == F.col("_k")).withColumn(own[0], F.pmod(F.xxhash64(*rows.columns), own[1]))
        return dealt(placed.select(*rows.columns, "_k", own[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[1]) - 1)).alias(other[0])), "_k", "_i", "_j")

    return side(left, a, ("_i", "_m"), ("_j", "_n")).join(side(right, b, ("_j", "_n"), ("_i", "_m")), ["_k", "_i", "_j"]).drop("_k", "_i", "_j")


def all_candidates(docs: DataFrame, editions: DataFrame, title_score=scorers.title_score, author_score=scorers.match_score, block: int = BLOCK) -> DataFrame:
    """All candidates by the stages and scores of ``generated``, without its cuts: pairs between classes, and who is in them.

    Documents, and editions, equal in title and author are a class by ``words``, those with the same ISBN one by ``isbn``; each
    is named after its smallest id. Rows (part, by, id, edition, score, method, of) are of three parts: ``pair``, two classes
    by ``by`` that are candidates of each other; ``document`` and ``edition``, a member and the class ``of`` it. So copies are
    not expanded: a document's candidates are the members of the classes that its own two classes meet, and where both
    give one edition the ISBN holds (``expanded``). An id with several rows has the candidates of each.
    """
    side = lambda rows, name, k: rows.select(F.col("of").alias(name), F.col("title").alias(f"{k}_title"), F.col("author").alias(f"{k}_author"), F.lower("title").alias(f"{k}_key"), F.substring(F.lower("title"), 1, PREFIX).alias(f"{k}_prefix"))
    (d_words, d), (e_words, e) = _classes(docs, "id", ["title", "author"]), _classes(editions, "edition", ["title", "author"])
    (d_isbn, d_numbers), (e_isbn, e_numbers) = (_classes(rows.where("isbn is not null"), key, ["isbn"]) for rows, key in ((docs, "id"), (editions, "edition")))
    d, e = side(d, "id", "d"), side(e, "edition", "e")
    same = lambda what: F.coalesce(F.col(f"d_{what}") == F.col(f"e_{what}"), F.lit(False))
    same_author = F.coalesce(F.lower("d_author") == F.lower("e_author"), F.lit(False))
    numbers = _meetings(d_numbers.select(F.col("of").alias("id"), F.col("isbn").alias("d_isbn")), e_numbers.select(F.col("of").alias("edition"), F.col("isbn").alias("e_isbn")), "d_isbn", "e_isbn", block)
    by_isbn = numbers.select("id", "edition").distinct().select(F.lit("isbn").alias("by"), "id", "edition", F.lit(1.0).alias("score"), F.lit("exact_isbn").alias("method"))
    by_title = _meetings(d, e, "d_key", "e_key", block).select(F.lit("words").alias("by"), "id", "edition", F.when(same_author, 1.0).otherwise(0.8).alias("score"), F.when(same_author, "exact_title_author").otherwise("exact_title").alias("method"))
    pool = _meetings(d, e, "d_prefix", "e_prefix", block).unionByName(_meetings(d, e, "d_author", "e_author", block).where(~same("prefix"))).where(~same("key"))
    fuzzy = _fuzzy(pool, title_score, author_score).select(F.lit("words").alias("by"), "id", "edition", "score", F.lit("fuzzy").alias("method"))
    members = lambda part, key, by, rows: rows.select(F.lit(part).alias("part"), F.lit(by).alias("by"), key, "of")
    found = [by_isbn.union(by_title).union(fuzzy).select(F.lit("pair").alias("part"), "*"), *(members("document", "id", *k) for k in (("words", d_words), ("isbn", d_isbn))), *(members("edition", "edition", *k) for k in (("words", e_words), ("isbn", e_isbn)))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def expanded(found: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, edition, score, method) of all candidates that ``all_candidates`` found, of the documents ``asked`` (id) alone if these are
    given; the same ISBN goes before the words of two."""
    documents, editions = (found.where(F.col("part") == part).select(F.col("by").alias(f"{key}_by"), key, F.col("of").alias(f"{key}_of")) for part, key in (("document", "id"), ("edition", "edition")))
    if asked is not None:
        documents = documents.join(asked.select(F.col("id").alias("_asked")).distinct(), F.col("id").eqNullSafe(F.col("_asked")), "left_semi")
    pairs = found.where("part = 'pair'").select("by", F.col("id").alias("left"), F.col("edition").alias("right"), "score", "method")
    met = pairs.join(documents, (F.col("by") == F.col("id_by")) & F.col("left").eqNullSafe(F.col("id_of"))).join(editions, (F.col("by") == F.col("edition_by")) & F.col("right").eqNullSafe(F.col("edition_of")))
    met = met.select("id", "edition", "by", "score", "method")
    first = met.where("by = 'isbn'").select(F.col("id").alias("_i"), F.col("edition").alias("_e")).distinct()
    taken = F.col("id").eqNullSafe(F.col("_i")) & F.col("edition").eqNullSafe(F.col("_e"))
    return met.where("by = 'isbn'").union(met.where("by = 'words'").join(first, taken, "left_anti")).select("id", "edition", "score", "method")


def best_match(pairs: DataFrame, title: Column, author: Column, least: tuple[float, float, float] = (0.55, 0.50, 0.50)) -> DataFrame:
    """(id, candidate, score): of pairs (id, candidate) the best by 0.6 title + 0.4 author; pairs below the least title or
    author score, and a best one below the least score, are none. A null author score (one is not known) counts 0."""
    known = pairs.withColumn("_t", title).withColumn("_a", author).where((F.col("_t") >= least[0]) & (F.col("_a").isNull() | (F.col("_a") >= least[1])))
    scored = known.withColumn("score", 0.6 * F.col("_t") + 0.4 * F.coalesce("_a", F.lit(0.0)))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("candidate")).alias("n"))).alias("m"))
    return best.select("id", (-F.col("m.n")).alias("candidate"), F.col("m.score").alias("score")).where(F.col("score") >= least[2])


def reviewed(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """``matches`` (id, document, status) after decisions (id, decision): only candidates are decided, decisions are accepted
    or rejected, and a document takes one accepted match: where one stands already, or several are accepted at once, the
    smallest id wins and the others stay candidates."""
    asked = decisions.where(F.col("decision").isin("accepted", "rejected")).groupBy("id").agg(F.min("decision").alias("decision"))
    joined = matches.join(asked, "id", "left").withColumn("take", F.coalesce((F.col("status") == "candidate") & (F.col("decision") == "accepted"), F.lit(False)))
    first = joined.groupBy("document").agg(F.max((F.col("status") == "accepted").cast("int")).alias("had"), F.min(F.when(F.col("take"), F.col("id"))).alias("winner"))
    decided = F.when((F.col("status") == "candidate") & (F.col("decision") == "rejected"), "rejected").when(F.col("take") & (F.col("had") == 0) & (F.col("id") == F.col("winner")), "accepted").otherwise(F.col("status"))
    return joined.join(first, "document").select("id", "document", decided.alias("status"))


def cover_score(source: Column, valid: Column, pixels: Column, local: Column) -> Column:
    """A cover's worth by source (40, 35, 30), 30 if valid, up to 20 by pixels in millions, and 10 if it is kept here."""
    base = F.when(source == "local", 40).when(source == "publisher", 35).when(source == "provider", 30).otherwise(0)
    return base + F.when(F.coalesce(valid, F.lit(False)), 30).otherwise(0) + F.least(F.coalesce(pixels, F.lit(0)) / 1e6, F.lit(20.0)) + F.when(F.coalesce(local, F.lit(False)), 10).otherwise(0)


def joined_names(signals: list[Column]) -> Column:
    """The distinct names of several signals, in their order."""
    return F.array_distinct(F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in signals]))


def accepted_title(signals: list[Column]) -> Column:
    """The first name of the signals if only one signal has any, or if two or more name it; else null."""
    every = joined_names(signals)
    told = sum((F.when(F.coalesce(F.size(s), F.lit(0)) > 0, 1).otherwise(0) for s in signals), F.lit(0))
    top = F.try_element_at(every, F.lit(1))
    says = sum((F.when(F.coalesce(F.array_contains(s, top), F.lit(False)), 1).otherwise(0) for s in signals), F.lit(0))
    return F.when((told <= 1) | (says >= 2), top)


def accepted_authors(signals: list[Column]) -> Column:
    """The only signal's names, or all names if every signal with any shares one; else none."""
    none = F.array().cast("array<string>")
    said = F.filter(F.array(*[F.coalesce(s, none) for s in signals]), lambda s: F.size(s) > 0)
    shared = F.aggregate(F.slice(said, F.lit(2), F.size(said)), F.element_at(said, 1), lambda a, b: F.array_intersect(a, b))
    return F.when(F.size(said) == 0, none).when(F.size(said) == 1, F.try_element_at(said, F.lit(1))).when(F.size(shared) > 0, joined_names(signals)).otherwise(none)


def entry_status(supported: Column, readable: Column, deferred: Column, book: Column, titles: Column, accepted: Column) -> Column:
    """A manifest entry's status, by the first that holds: unsupported, deferred, unreadable, not_a_book, empty, ambiguous, ok."""
    return F.when(~supported, "unsupported").when(deferred, "deferred").when(~readable, "unreadable").when(~book, "not_a_book").when(F.size(titles) == 0, "empty").when(accepted.isNull(), "ambiguous").otherwise("ok")


def refreshed(old: DataFrame, new: DataFrame, key: str, identity: list[str], build) -> DataFrame:
    """Entries for ``new``: those of which the identity is as before are taken from ``old``, the others are built by
    ``build(rows)``; entries without a new row go."""
    same = new.select(key, *identity).join(old.select(key, *identity), [key, *identity], "left_semi").select(key)
    return old.join(same, key, "left_semi").unionByName(build(new.join(same, key, "left_anti")))


# --- Records


def parsed_records(records: DataFrame, raw: str = "raw") -> DataFrame:
    """``records`` (source, title, raw) with ``parsed``: title, authors, publisher, language, page_count, isbn and url from
    three shapes of payload: ``volumeInfo`` inside, ``data`` inside, or ``specification`` inside or as JSON text."""
    json = lambda *paths: F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in (F.get_json_object(raw, p) for p in paths)])
    inside = F.when(F.col("source") == "google_books", F.coalesce(F.get_json_object(raw, "$.volumeInfo"), F.col(raw))).when(F.col("source") == "open_library", F.coalesce(F.get_json_object(raw, "$.data"), F.col(raw))).otherwise(F.coalesce(F.get_json_object(raw, "$.specification"), F.col(raw)))
    rows = records.withColumn("_in", inside)
    at = lambda *names: F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in (F.get_json_object("_in", f"$['{n}']") for n in names)])
    listed = lambda v: F.when(v.startswith("["), F.filter(F.from_json(v, "array<string>"), lambda x: F.trim(x) != "")).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))
    named = lambda names: F.transform(names, lambda n: F.coalesce(F.get_json_object(n, "$.name"), F.trim(n)))
    fields = {
        "title": F.coalesce(at("title", "Title"), json("$.name"), F.col("title"), F.lit("")),
        "authors": F.array_distinct(named(listed(at("Author/Editor", "Author", "authors", "author", "authors_name")))),
        "publisher": at("publisher", "Publisher"), "language": F.coalesce(at("language", "Language"), json("$.language")),
        "page_count": F.regexp_extract(F.coalesce(at("pageCount", "number_of_pages", "Number of Pages"), F.lit("")), "[0-9]+", 0).try_cast("int"),
        "isbn": at("ISBN", "isbn", "isbn13", "isbn_13"), "url": json("$.url"),
    }
    return rows.withColumn("parsed", F.struct(*[v.alias(k) for k, v in fields.items()])).drop("_in")


def safe_number(value: Column, most: float | None = None) -> Column:
    """A number of zero or more, at most ``most``; null for anything else, also for booleans and infinities."""
    n = F.when(~F.lower(F.trim(value)).isin("true", "false"), F.trim(value)).try_cast("double")
    good = (n >= 0) & (n < float("inf")) & ~F.isnan(n)
    return F.when(good & ((n <= most) if most is not None else F.lit(True)), n)


def safe_url(value: Column) -> Column:
    return F.when(F.trim(value).rlike("^https?://"), F.trim(value))


def ratings(records: DataFrame, raw: str = "raw") -> DataFrame:
    """``records`` (source, raw) that give a rating of 0 to 5, with value, rating_count and review_count, by the fields of their
    source; counts are whole numbers or null, and one source must give its count."""
    v = lambda p: F.get_json_object(raw, p)
    by = lambda a, b, c: F.when(F.col("source") == "rokomari", v(a)).when(F.col("source") == "google_books", v(b)).when(F.col("source") == "goodreads", F.coalesce(v(c.replace("$.", "$.goodreads.")), v(c)))
    count = lambda c: F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c)).try_cast("long")
    out = records.withColumns({"value": safe_number(by("$.ratingValue", "$.volumeInfo.averageRating", "$.average_rating"), 5.0), "rating_count": count(by("$.ratingCount", "$.volumeInfo.ratingsCount", "$.ratings_count")), "review_count": count(by("$.reviewCount", "$.none", "$.reviews_count"))})
    return out.where("value is not null and (source <> 'goodreads' or rating_count is not null)")


def changed_ratings(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``new`` with ``changed``: whether a rating is new or differs from the one that stands."""
    before = old.select(*key, F.struct(*values).alias("_old"))
    joined = new.join(before, key, "left")
    return joined.withColumn("changed", F.col("_old").isNull() | ~F.struct(*values).eqNullSafe(F.col("_old"))).drop("_old")


def identifiers(raw: Column, external: Column) -> Column:
    """(namespace, value) pairs of a record: its canonical id (the external one, unless it only numbers a line; else the
    first of id, product id and sku; else the address), then these three, each once."""
    v = lambda p: F.when(F.trim(F.get_json_object(raw, p)) != "", F.trim(F.get_json_object(raw, p)))
    named = [("rokomari:id", v("$.id")), ("rokomari:product_id", v("$.productId")), ("rokomari:sku", v("$.sku"))]
    given = F.when((F.trim(external) != "") & ~external.startswith("line:"), F.trim(external))
    numbered = F.when(F.trim(external) != "", F.trim(external))
    canonical = F.coalesce(given, *[c for _, c in named], numbered, v("$.url"))
    pair = lambda n, c: F.when(c.isNotNull(), F.struct(F.lit(n).alias("namespace"), c.alias("value")))
    return F.array_distinct(F.array_compact(F.array(pair("rokomari", canonical), *[pair(n, c) for n, c in named])))


def materialized(records: DataFrame) -> dict[str, DataFrame]:
    """Works, editions, people, edition_people and identifiers of records (record, title, authors, isbn).

    A work is a sort key and a set of authors, an edition a work and an ISBN (without one, a record of its own); each is
    named after its smallest record, so a rerun over more records keeps ids unless a smaller record joins. An ISBN belongs
    to the first record that gives it. People are names, numbered by place; blank names are none.
    """
    rows = records.where("trim(title) <> ''").withColumn("sort_title", F.lower(F.trim("title"))).withColumn("people", F.array_sort(F.array_distinct(F.filter("authors", lambda a: F.trim(a) != ""))))
    works = rows.groupBy("sort_title", "people").agg(F.min("record").alias("work_id"), F.count("*").alias("records"))
    placed = rows.join(works.select("sort_title", "people", "work_id"), ["sort_title", "people"])
    part = F.coalesce("isbn", F.concat(F.lit("record:"), F.col("record").cast("string")))
    editions = placed.withColumn("part", part).groupBy("work_id", "part").agg(F.min("record").alias("edition_id"), F.min("isbn").alias("isbn"))
    listed = placed.withColumn("part", part).join(editions.select("work_id", "part", "edition_id"), ["work_id", "part"]).where("record = edition_id")
    people = listed.select("edition_id", F.posexplode(F.array_distinct(F.filter("authors", lambda a: F.trim(a) != ""))).alias("place", "name"))
    owners = editions.where("isbn is not null").groupBy("isbn").agg(F.min("edition_id").alias("owner_id"))
    return {"works": works.select("work_id", "sort_title", "records"), "editions": editions.select("edition_id", "work_id", "isbn"), "people": people.select("name").distinct(), "edition_people": people, "identifiers": owners}


def repaired_people(edition_people: DataFrame, record_editions: DataFrame, records: DataFrame, suspect: str) -> DataFrame:
    """(edition_id, place, name) after a repair: editions with a record of source ``suspect`` that gives no author keep only
    people that some record of theirs (record, source, authors) gives, numbered anew from 0; other editions stay."""
    mapped = record_editions.join(records, "record")
    touched = mapped.where((F.col("source") == suspect) & (F.size("authors") == 0)).select("edition_id").distinct()
    allowed = mapped.select("edition_id", F.explode("authors").alias("name")).distinct()
    kept = edition_people.join(touched, "edition_id", "left_semi").join(allowed, ["edition_id", "name"], "left_semi")
    place = (F.row_number().over(Window.partitionBy("edition_id").orderBy("place", "name")) - 1).cast("int")
    return edition_people.join(touched, "edition_id", "left_anti").select("edition_id", "place", "name").union(kept.select("edition_id", place.alias("place"), "name"))


def nested(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """``parents`` with an array of structs for each kind of children: their table, the column that names the parent, and
    the fields, by which they are sorted; empty without children."""

    def with_children(rows: DataFrame, child) -> DataFrame:
        name, (table, parent, fields) = child
        kind = F.struct(*fields)
        lists = table.groupBy(F.col(parent).alias("_parent")).agg(F.array_sort(F.collect_list(kind)).alias(name))
        out = rows.join(lists, F.col(key) == F.col("_parent"), "left").drop("_parent")
        return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))

    return reduce(with_children, children.items(), parents)
