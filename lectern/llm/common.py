"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a batch function gathers before it hands rows on.
BATCH_BYTES = 8 << 20


def word_count(text: str = "text") -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def class_key(column: str) -> Column:
    """A non-null string that sorts like ``column`` by code point, with null last."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


_KEYS = ["k1", "k2", "k3"]


def _row_keys(doc_id: Column, text_hash: Column) -> list[Column]:
    """Keys that are never null, equal for equal ids, nulls too, and hashes."""
    return [k.alias(n) for k, n in zip((F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.coalesce(text_hash, F.lit(0))), _KEYS)]


def only_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id and hash of the text are in ``kept`` (doc_id, text_hash); of
    rows that repeat both, one. Rows are dealt once, by the keys that both steps share."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_row_keys(docs["doc_id"], F.xxhash64(docs["text"])))
    return rows.join(kept.select(*_row_keys(kept["doc_id"], kept["text_hash"])), _KEYS, "left_semi").dropDuplicates(_KEYS).select("row.*")


def hashes_among(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, ...) whose first two are in ``kept``: as ``only_rows``, where no text is needed, so none is dealt."""
    keyed = rows.select(*rows.columns, *_row_keys(rows["doc_id"], rows["text_hash"]))
    return keyed.join(kept.select(*_row_keys(kept["doc_id"], kept["text_hash"])), _KEYS, "left_semi").select(*rows.columns)
