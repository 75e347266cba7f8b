"""Documents for training: language ID, near-dedup, substring dedup, mixing, packing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langid, mixing, neardup, packing, queries, simhash, substring
from lectern.storage import delete, freed_shuffles, scratch, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the corpus' labels teach; text without letters or in none of them goes."""
    docs = docs if docs is not None else queries.table(spark, sf_dir, "documents")
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose SimHash fingerprints link at three bits or fewer, that with the smallest
    doc_id; then, as near texts may differ in more bits, one of each group that a five-word Jaccard similarity of 0.8 links."""
    return neardup.keep_first(docs, simhash.first_rows(docs, radius=3))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of all but the first document that has them; documents of which nothing is left go."""
    clean = substring.cleaned(docs).where("removed = 0 or text rlike '\\\\S'")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows that hold the sources in the mix's proportions; a row for each piece."""
    return packing.pack(docs, queries.tokenizer(), queries.WINDOW, queries.END).drop("cls")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The stages need n-gram profiles, fingerprints and a tokenizer; they are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's are written to the shared folder and read again by the next, and go when that
    one's are written."""
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, numbered: tuple) -> DataFrame:
        k, (name, stage) = numbered
        with scratch(spark), freed_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        if k:
            delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        return spark.read.parquet(f"{base}/{k}-{name}")

    return reduce(step, enumerate(STAGES), queries.table(spark, sf_dir, "documents"))
