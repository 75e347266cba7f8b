"""The duplicate graph: typed edges, vetoes, clusters by relation, the copy to keep, what may go, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import keys, scorers
from lectern.operators.components import connected_components
from lectern.storage import cut

#: Methods that see metadata alone, and how far sources are trusted.
METADATA = ("metadata_exact", "metadata_fuzzy")
TRUST = {"gutenberg_bengali": 1.0, "bengaliebook": 0.8, "rarebooksociety": 0.6, "authordir": 0.4, "amarboi": 0.3, "banglabookshelf": 0.2, "banglabooks_in": 0.2, "amarbooks": 0.1, "granthagara": 0.0}
#: Documents of a cluster beyond which a person looks at it, and characters of a title that tells anything.
REVIEW_OVER, TITLE_KEY = 8, 8


def relation(method: Column, left: Column, right: Column) -> Column:
    """What an edge claims by its method and its ends' media types: ``duplicate`` (same content, same type),
    ``format_variant`` (across types), else ``same_work``: metadata, texts of one type, or an unknown type."""
    unknown = F.coalesce(left, F.lit("")) == "", F.coalesce(right, F.lit("")) == ""
    return F.when(method.isin(*METADATA) | unknown[0] | unknown[1], "same_work").when(left != right, "format_variant").when(method == "text_minhash", "same_work").otherwise("duplicate")


def typed(edges: DataFrame, media: DataFrame) -> DataFrame:
    """Edges (a, b, method) with ends in order and their relation by the media types (doc_id, media)."""
    ends = [media.select(F.col("doc_id").alias(k), F.col("media").alias(f"{k}_media")) for k in "ab"]
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in "ab"])
    joined = ordered.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return joined.withColumn("relation", relation(F.col("method"), F.col("a_media"), F.col("b_media"))).drop("a_media", "b_media")


def title_edges(docs: DataFrame, title: Column, most: int = 20) -> DataFrame:
    """(a, b, method, score) of documents with the same title key of 8 characters or more. A title of over ``most``
    documents is a template and no evidence: ``resolution.large_blocks`` tells its members."""
    keyed = docs.select("doc_id", title.alias("title")).where(F.char_length("title") >= TITLE_KEY)
    few = keyed.groupBy("title").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("title")
    kept = keyed.join(few, "title")
    pairs = kept.select("title", F.col("doc_id").alias("a")).join(kept.select("title", F.col("doc_id").alias("b")), "title").where("a < b")
    return pairs.select("a", "b", F.lit("metadata_exact").alias("method"), F.lit(1.0).alias("score"))


def vetoed(edges: DataFrame, facts: DataFrame, least: float = 30.0) -> DataFrame:
    """Edges (a, b, method) with ``vetoed``: content edges of which the names (doc_id, name, title) state other volumes, or
    of which both titles tell something and share next to no words. Metadata edges stay."""
    ends = [facts.select(F.col("doc_id").alias(k), F.col("name").alias(f"{k}_name"), F.coalesce("title", F.lit("")).alias(f"{k}_title")) for k in "ab"]
    joined = edges.join(ends[0], "a", "left").join(ends[1], "b", "left")
    volumes = keys.volume_conflict(F.coalesce("a_name", F.lit("")), F.coalesce("b_name", F.lit("")))
    told = (F.char_length("a_title") >= TITLE_KEY) & (F.char_length("b_title") >= TITLE_KEY)
    titles = told & (scorers.fuzz_token_set("a_title", "b_title") < least)
    return joined.withColumn("vetoed", ~F.col("method").isin(*METADATA) & (volumes | titles)).drop("a_name", "b_name", "a_title", "b_title")


def all_clusters(edges: DataFrame, review_over: int = REVIEW_OVER) -> DataFrame:
    """(doc_id, relation, cluster_id, size, methods, status) of the components of each relation's edges: relations never chain
    into each other. Edges are computed once, and all relations contracted together, a node being a relation and an id."""
    own = cut(edges.select(*[F.struct("relation", F.col(k).alias("id")).alias(k) for k in "ab"], "method").distinct())
    members = cut(connected_components(own.select("a", "b")))
    methods = own.join(members, F.col("a") == F.col("node")).groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).join(methods, "root")
    status = F.when(F.col("size") > review_over, "review").otherwise("auto")
    return members.join(sizes, "root").select(F.col("node.id").alias("doc_id"), "node.relation", F.col("root.id").alias("cluster_id"), "size", "methods", status.alias("status"))


def clusters(edges: DataFrame, kind: str, review_over: int = REVIEW_OVER) -> DataFrame:
    """The clusters of one relation."""
    return all_clusters(edges.where(F.col("relation") == kind), review_over)


def summary(found: DataFrame) -> DataFrame:
    """One row: clusters of each relation, those for review, their documents, and copies that could go."""
    each = found.select("relation", "cluster_id", "size", "status").distinct()
    count = lambda c: F.count_if(c)
    free = (F.col("relation") == "duplicate") & (F.col("status") == "auto")
    return each.agg(F.count("*").alias("clusters"), *[count(F.col("relation") == k).alias(f"{k}_clusters") for k in ("duplicate", "format_variant", "same_work")], count(F.col("status") == "review").alias("review_clusters"),
                    F.coalesce(F.sum("size"), F.lit(0)).alias("documents_in_clusters"), F.coalesce(F.sum(F.when(free, F.col("size") - 1)), F.lit(0)).alias("removable_copies"))


def scored(members: DataFrame, cluster: str = "cluster_id", trust: dict[str, float] | None = None) -> DataFrame:
    """``members`` with the quality of each copy: 4 * confidence / 100 where measured, 3 with a text layer, 2 by pages of the
    most, 1 by size of the largest where page counts agree within 2 % (a page at least), 1 each with title and authors, 1.5
    if matched, and the trust in its source. Extremes are aggregated by cluster and joined."""
    has = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    pages = F.when(F.col("pages") > 0, F.col("pages"))
    ends = members.groupBy(cluster).agg(F.max(pages).alias("_most"), F.min(pages).alias("_least"), F.max("size_bytes").alias("_largest"))
    agree = F.coalesce(F.col("_most") - F.col("_least") <= F.greatest(F.lit(1), F.floor(F.col("_most") * 0.02)), F.lit(False))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    known = F.lit(0.0)
    for name, value in (TRUST if trust is None else trust).items():
        known = F.when(F.col("source") == name, value).otherwise(known)
    total = (zero(4.0 * F.col("confidence") / 100) + has("text_layer", 3.0) + zero(F.try_divide(2.0 * pages, F.col("_most"))) + F.when(agree, zero(F.try_divide(F.col("size_bytes").cast("double"), F.col("_largest")))).otherwise(0.0)
             + has("title", 1.0) + has("authors", 1.0) + has("matched", 1.5) + known)
    return members.join(ends, cluster).withColumn("score", total).drop("_most", "_least", "_largest")


def keepers(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, keeper_id): the copy with the best score, ties to the smallest id."""
    return members.groupBy(cluster).agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("keeper_id"))


def removable(found: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, keeper_id): members of automatic duplicate clusters with a duplicate edge of their own to the keeper."""
    direct = edges.where("relation = 'duplicate'").select("a", "b").distinct()
    free = found.where("relation = 'duplicate' and status = 'auto'").join(kept, "cluster_id").where("doc_id <> keeper_id")
    both = (F.least("doc_id", "keeper_id") == F.col("a")) & (F.greatest("doc_id", "keeper_id") == F.col("b"))
    return free.join(direct, both, "left_semi").select("doc_id", "keeper_id")


def report_claims(inventory: DataFrame, gone: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row, the head of a report: paths, ok, unreadable, unsupported and failed by ``inventory`` (status); copies and bytes
    that may go by ``gone`` (bytes); documents in clusters by ``clusters`` (cluster_id, size), a row for each."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    one = inventory.agg(F.count("*").alias("paths"), n("ok"), n("unreadable"), n("unsupported"), F.count_if(F.col("status") != "ok").alias("failed"))
    going = gone.agg(F.count("*").alias("copies"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    held = clusters.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("members"))
    return one.join(F.broadcast(going)).join(F.broadcast(held))  # a row each


def reconciled(claims: DataFrame, failures: DataFrame, gone: DataFrame, members: DataFrame) -> DataFrame:
    """(check, ok) of the eight statements that a written report must keep, each a claim of its head against its lists: paths
    by status add up, failures are all listed, the removable copies and their bytes are those listed, no path goes twice, no
    keeper goes, every one has a hash, and clusters hold the documents claimed. ``claims`` is the head (``report_claims``),
    ``failures`` has a row for each failed path, ``gone`` (path, keeper_path, sha, bytes), ``members`` a row for each
    member of a cluster."""
    listed = failures.agg(F.count("*").alias("l_failed"))
    going = gone.agg(F.count("*").alias("l_copies"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("l_bytes"), F.count_if(F.coalesce("sha", F.lit("")) == "").alias("unhashed"), F.count_if(F.col("path") == F.col("keeper_path")).alias("kept"), F.countDistinct("path").alias("l_paths"))
    held = members.agg(F.count("*").alias("l_members"))
    row = claims.join(F.broadcast(listed)).join(F.broadcast(going)).join(F.broadcast(held))  # a row each
    same = lambda c: F.col(c) == F.col(f"l_{c}")
    checks = {"paths by status": F.col("paths") == F.col("ok") + F.col("unreadable") + F.col("unsupported"), "failures listed": same("failed"), "removable copies": same("copies"), "bytes saved": same("bytes"),
              "no path twice": F.col("l_copies") == F.col("l_paths"), "no keeper goes": F.col("kept") == 0, "all hashed": F.col("unhashed") == 0, "members of clusters": same("members")}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])).alias("c")).select("c.check", "c.ok")


def families(docs: DataFrame, edges: DataFrame, least: float = 0.90, certain: float = 0.98) -> DataFrame:
    """(doc_id, family, members, unconfirmed): components over edges (a, b, relation, score, confirmed) that are confirmed,
    join equal contents, or score ``least`` or more. ``unconfirmed`` counts the edges that a person should look at: applied
    ones with a score above 0 and below ``certain``, and all that were not applied, at both their ends' families."""
    ends = [docs.select(F.col("doc_id").alias(k), F.col("content").alias(f"{k}_content")) for k in "ab"]
    known = edges.where("a <> b").join(ends[0], "a").join(ends[1], "b")
    applied = F.coalesce(F.col("confirmed"), F.lit(False)) | ((F.col("relation") == "byte_identical") & (F.col("a_content") == F.col("b_content"))) | (F.col("score") >= least)
    known = cut(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", applied.alias("applied")))
    roots = cut(connected_components(known.where("applied").select("a", "b")))
    placed = docs.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("family"))
    doubtful = known.where(f"(applied and score > 0 and score < {certain}) or not applied").select("a", "b").distinct()
    flagged = doubtful.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id")).join(placed, "doc_id").select("family", "a", "b").distinct().groupBy("family").agg(F.count("*").alias("unconfirmed"))
    sizes = placed.groupBy("family").agg(F.count("*").alias("members"))
    return placed.join(sizes, "family").join(flagged, "family", "left").select("doc_id", "family", "members", F.coalesce("unconfirmed", F.lit(0)).alias("unconfirmed"))


def replace_automatic(old: DataFrame, new: DataFrame) -> DataFrame:
    """A rerun's clusters with the old ones that a person confirmed or rejected; automatic ones are replaced."""
    return old.where(~F.col("status").isin("auto", "review")).unionByName(new)


def last_written(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each (a, b, method) with its ends in order: the last one written."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[c for c in edges.columns if c not in "ab"])
    last = F.row_number().over(Window.partitionBy("a", "b", "method").orderBy(F.desc(order)))
    return ordered.withColumn("_r", last).where("_r = 1").drop("_r")
