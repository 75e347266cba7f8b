"""Whole jobs on a corpus: fuzzy lookup, covers, analysis of duplicates, moves and their rollback, pages of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import keys, scorers
from lectern.functions.text import collapsed
from lectern.operators import dedupe, spatial
from lectern.operators.components import connected_components
from lectern.operators.relations import top_per_group
from lectern.storage import broadcast_within, cut

# --- Fuzzy lookup


def _grams(key: Column) -> Column:
    """Pairs of neighbouring characters, each numbered among its equals."""
    n = F.char_length(key)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(key, i, F.lit(2)))).otherwise(F.array(key))
    return F.transform(pairs, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).alias("k")))


def fuzzy_lookup(queries: DataFrame, entries: DataFrame, least: float = 88.0) -> DataFrame:
    """(id, entry, score): for each query (id, key) the entry (entry, key) with the best Indel ratio of ``least`` or more, ties to
    the smaller entry.

    Equal keys are compared once. A pair at the ratio r differs in at most (1 - r) of both lengths' sum characters, each of
    which spoils two pairs of neighbours at most, and their lengths differ by no more; so of either key's rarest pairs, few
    more than can be spoiled, one is shared. Only keys that meet there, at a fitting length, are scored: no cross join, and
    nothing at the ratio is missed. Common pairs are last in order, so they make no large groups.
    """
    loss = 1 - least / 100
    mine = queries.where(F.col("key") != "").select("key").distinct()
    own = entries.where(F.col("key") != "").groupBy("key").agg(F.min("entry").alias("entry"))
    counts = own.select(F.explode(_grams(F.col("key"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def rare(keyed: DataFrame) -> DataFrame:
        """The first pairs of each key by rarity: so many as edits within the ratio can spoil, and one more."""
        each = keyed.select("key", F.explode(_grams(F.col("key"))).alias("g")).join(broadcast_within(cut(counts), 50_000), "g", "left")
        most = F.floor(F.char_length("key") * (1 + (1 + loss) / (1 - loss)) * loss) * 2 + 1
        order = Window.partitionBy("key").orderBy(F.coalesce("n", F.lit(0)), "g")
        return each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("key", "g")

    left, right = rare(mine), rare(own.select("key"))
    met = left.select(F.col("key").alias("a"), "g").join(right.select(F.col("key").alias("b"), "g"), "g").select("a", "b").distinct()
    fit = F.least(F.char_length("a"), F.char_length("b")) >= F.greatest(F.char_length("a"), F.char_length("b")) * (1 - loss) / (1 + loss)
    scored = met.where(fit).withColumn("score", scorers.fuzz_ratio("a", "b")).where(F.col("score") >= least)
    best = scored.join(own, F.col("b") == F.col("key")).groupBy("a").agg(F.max(F.struct("score", (-F.col("entry")).alias("e"))).alias("m"))
    return queries.join(best, F.col("key") == F.col("a")).select("id", (-F.col("m.e")).alias("entry"), F.col("m.score").alias("score"))


def resolved_covers(blocks: DataFrame, titles: DataFrame, people: DataFrame, least: float = 88.0) -> DataFrame:
    """(cover, title_id, person_id) of covers' text blocks (cover, place, text) against titles (entry, key) and people (entry,
    key): an exact key first, then the best fuzzy one; a block that names a person is no title, and of several blocks the
    first counts."""
    named = blocks.select("cover", "place", keys.normalize_text("text").alias("key"), F.concat_ws(":", F.col("cover").cast("string"), F.col("place").cast("string")).alias("id")).where("key <> ''")

    def found(rows: DataFrame, entries: DataFrame, name: str) -> DataFrame:
        exact = rows.join(entries.groupBy("key").agg(F.min("entry").alias("entry")), "key").select("id", "entry")
        fuzzy = fuzzy_lookup(rows.join(exact, "id", "left_anti").select("id", "key"), entries, least).select("id", "entry")
        return exact.union(fuzzy).withColumnRenamed("entry", name)

    persons = cut(found(named, people, "person_id"))
    works = found(named.join(persons, "id", "left_anti"), titles, "title_id")
    both = named.join(persons, "id", "left").join(works, "id", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    return both.groupBy("cover").agg(first("title_id"), first("person_id"))


def cover_reading(regions: DataFrame, page: str) -> DataFrame:
    """(page, titles, authors): of a cover's regions (height, text, id), the three tallest as titles and the second to fourth
    as authors; ties to the smaller id. Four of a cover are gathered, however many it has."""
    tall = top_per_group(regions.select(page, "height", "id", "text"), page, [F.desc("height"), F.col("id")], 4)
    texts = tall.groupBy(page).agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "id", "text"))).alias("t")).select(page, F.transform("t", lambda r: r["text"]).alias("t"))
    return texts.select(page, F.slice("t", 1, 3).alias("titles"), F.slice("t", 2, 3).alias("authors"))


# --- Duplicates


def document_facts(docs: DataFrame, raw: str = "metadata") -> DataFrame:
    """(doc_id, title_key, author_key, has_title, has_authors, pages) of documents (doc_id, path, metadata as JSON): title and
    author fall back to the path; what is not told is null."""
    at = lambda p: F.when(F.trim(F.get_json_object(raw, p)) != "", F.trim(F.get_json_object(raw, p)))
    told = F.coalesce(at("$.authors[0]"), at("$.author"))
    return docs.select("doc_id", keys.normalize_text(F.coalesce(at("$.title"), keys.path_title(F.col("path")))).alias("title_key"), keys.normalize_name(F.coalesce(told, keys.path_author(F.col("path")))).alias("author_key"),
                       at("$.title").isNotNull().alias("has_title"), told.isNotNull().alias("has_authors"), at("$.pages").try_cast("int").alias("pages"))


def analysed(docs: DataFrame, signers: dict[str, Callable[[DataFrame], DataFrame]], facts: DataFrame) -> dict[str, DataFrame]:
    """Edges, clusters, keepers and removals of a corpus (doc_id, media, ..). ``signers`` are the ways to find edges by method,
    each from documents to pairs (a, b); ``facts`` has (doc_id, name, title) for vetoes and what ``dedupe.scored`` reads."""
    pairs = None
    for method, find in signers.items():
        found = find(docs).select("a", "b", F.lit(method).alias("method"))
        pairs = found if pairs is None else pairs.unionByName(found)
    edges = dedupe.typed(pairs, docs.select("doc_id", "media"))
    kept = cut(dedupe.vetoed(edges, facts.select("doc_id", "name", "title")).where("not vetoed").drop("vetoed"))
    clusters = cut(dedupe.all_clusters(kept))
    members = clusters.where("relation = 'duplicate'").join(facts.drop("name", "title").withColumnRenamed("has_title", "title").withColumnRenamed("has_authors", "authors"), "doc_id")
    keepers = dedupe.keepers(dedupe.scored(members))
    return {"edges": kept, "clusters": clusters, "keepers": keepers, "removals": dedupe.removable(clusters, kept, keepers)}


def boilerplate_components(items: DataFrame, links: DataFrame, doc: str, item: str, least: int = 3) -> DataFrame:
    """(item, component, docs): items whose component over links (a, b) stands in ``least`` documents or more, as a banner does."""
    roots = connected_components(links)
    named = items.join(roots, F.col(item) == F.col("node"), "left").select(doc, item, F.coalesce("root", item).alias("component"))
    wide = named.groupBy("component").agg(F.countDistinct(doc).alias("docs")).where(F.col("docs") >= least)
    return named.select(item, "component").distinct().join(wide, "component")


def move_plan(removals: DataFrame, found: DataFrame, trash: str) -> DataFrame:
    """(path, target, sha256, action) for removals (path, sha256): ``move`` where the file (path, sha256) is still what it was,
    ``changed`` or ``missing`` else. The table is the manifest by which moves are made, and taken back."""
    now = found.select("path", F.col("sha256").alias("_now"))
    action = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "move").otherwise("changed")
    return removals.join(now, "path", "left").select("path", F.concat(F.lit(f"{trash}/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("target"), "sha256", action.alias("action"))


def rollback_plan(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, target, action) to undo the moves of a manifest: ``restore`` where the target (path, sha256) is there unchanged and
    the old place is free; ``occupied``, ``changed`` or ``missing`` else."""
    old = found.select(F.col("path").alias("_p"), F.lit(True).alias("_taken"))
    kept = found.select(F.col("path").alias("_t"), F.col("sha256").alias("_now"))
    joined = manifest.where("action = 'move'").join(old, F.col("path") == F.col("_p"), "left").join(kept, F.col("target") == F.col("_t"), "left")
    action = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "changed").when(F.coalesce("_taken", F.lit(False)), "occupied").otherwise("restore")
    return joined.select("path", "target", action.alias("action"))


# --- Pages


def aligned_pages(lines: DataFrame, regions: DataFrame, page: str, key: str, text: str) -> DataFrame:
    """(page, region, text): the text of each region's lines, rows from the top, from left to right inside a row; a line belongs
    to the region that covers half of it or more."""
    placed = spatial.assign(lines, regions, page, key)
    rows = lines.join(placed, F.col(key) == F.col("line"))
    ordered = spatial.rows_by_height(rows.select(F.concat_ws(":", F.col(page).cast("string"), F.col("region").cast("string")).alias("block"), F.col(key).alias("line_id"), "x0", "y0", "x1", "y1"), "block", "line_id")
    said = rows.join(ordered.select("line_id", "row"), F.col(key) == F.col("line_id"))
    each = said.groupBy(page, "region", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", F.col(key).alias("k"), F.col(text).alias("t")))), lambda r: r["t"]), " ").alias("t"))
    return each.groupBy(page, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda r: r["t"]), "\n").alias("text"))


def gold_entries(lines: DataFrame, paragraphs: DataFrame, page: str, key: str) -> DataFrame:
    """(entry_id, line, paragraph): lines with the smallest paragraph that holds them whole, null without one, under an id made
    from page, box and text, so that reruns agree."""
    inside = spatial.containing(lines, paragraphs, page, key)
    ident = F.substring(F.sha2(F.concat_ws("\0", F.col(page).cast("string"), *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")], collapsed(F.col("text"))), 256), 1, 32)
    return lines.join(inside, F.col(key) == F.col("line"), "left").select(ident.alias("entry_id"), F.col(key).alias("line"), F.col("region").alias("paragraph"))
