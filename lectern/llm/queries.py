"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, divergence, langid, media, mixing, ngram_join, oracles, packing, sharding, simhash, substring, token_output, toxicity, vector_codes
from lectern.llm.common import class_key, word_count
from lectern.storage import shared_dir

#: Tokens of a sequence, and what ends a document.
WINDOW, END = 2048, 1


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), WINDOW, END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the packed id matrix, written and read back, with checksums of ids and positions."""
    rows = token_output.pack_matrix(table(spark, sf_dir, "documents"), tokenizer(), WINDOW, END)
    rows = token_output.save(rows, f"{shared_dir(spark).rstrip('/')}/matrix-{uuid.uuid4().hex}")
    return rows.select("sequence_id", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text stored as lossless WebP, and what reading it back gives."""
    stored = media.stored_texts(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media.features("media").alias("read")).select(
        "doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", "media_bytes", "media_sha256", "read.feature")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the sentences that repeat others."""
    return substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document over links of a Jaccard similarity of 0.8 or more."""
    return ngram_join.similar_texts(table(spark, sf_dir, "documents"), 5, (4, 5))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are from each other and from the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each vector, its error, and that of all vectors with its label."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of each source, the part of the mix that SQL can express."""
    docs = table(spark, sf_dir, "documents")
    found = mixing.targets(docs.select(class_key("source").alias("cls"), word_count().alias("size")), weights=(5, 2, 1), share=1.5, cap=2.0)
    return found.select(F.when(F.col("cls") != "~", F.substring("cls", 2, 1 << 20)).alias("source"), "source_size", F.round("target", 6).alias("target"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_simhash, op4_token_output, op5_language_id, op6_toxicity, op7_webp, op8_substring, op9_sharding, op10_multi_index, op11_ngram_join, op12_divergence, op13_vector_codes, pipeline, mixing_targets)}

#: Queries that SQL can express over whole tables. The others are tested against brute force.
ORACLES: dict[str, str] = {"op11_ngram_join": oracles.NGRAM_JOIN, "op12_divergence": oracles.DIVERGENCE, "op13_vector_codes": oracles.lloyd(), "mixing_targets": r"""WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM w WINDOW p AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, level * w >= 2.0::DOUBLE * source_size AS capped FROM l), z AS (SELECT arg_min(level, (2.0::DOUBLE * source_size / w, source)) AS open FROM c WHERE NOT capped)
SELECT source, source_size, round(CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE open * w END, 6) AS target FROM c, z"""}
