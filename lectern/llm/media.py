"""Media columns: samples stored as lossless WebP, and WebP columns decoded into pixel arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.llm import webp
from lectern.storage import texts

#: Images that are decoded together, and payload bytes that bound them.
TOGETHER, BYTES = 2_000, 8 << 20
IMAGE = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("pixels", T.BinaryType())
READ = T.StructType().add("payload_bytes", T.LongType()).add("payload_sha256", T.StringType()).add("tail_crc32", T.LongType()).add("feature", T.StringType())


def _stored(batches):
    """(doc_id, n_bytes, payload) -> (doc_id, n_bytes, media)."""
    for batch in batches:
        media, held, first = [], 0, 0
        for i, file in enumerate(webp.encode_many(p.as_py() for p in batch.column(2))):
            media.append(file)
            held += len(media[-1])
            if held > BYTES or i + 1 == batch.num_rows:
                part = batch.slice(first, len(media))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                media, held, first = [], 0, i + 1


def _decoded(files):
    """Lists of [height, width] pixels, one list for each file, in bounded groups."""
    held, size = [], 0
    for f in files:
        held.append([] if f is None else webp.streams(f))
        size += sum(map(len, held[-1]))
        if size >= BYTES or sum(map(len, held)) >= TOGETHER:
            yield from _group(held)
            held, size = [], 0
    yield from _group(held)


def _group(held):
    images = iter(webp.decode_many([s for x in held for s in x]))
    for x in held:
        yield [next(images) for _ in x]


@pandas_udf(T.ArrayType(IMAGE))
def pixels(media: pd.Series) -> pd.Series:
    """The images of a WebP column: ``pixels`` has four bytes a pixel, blue, green, red and alpha, row by row; null gives
    no images. A file that is not lossless WebP is an error."""
    return pd.Series([[{"width": i.shape[1], "height": i.shape[0], "pixels": i.astype("<u4").tobytes()} for i in images] for images in _decoded(media)], dtype=object)


@pandas_udf(READ)
def features(media: pd.Series) -> pd.DataFrame:
    """What the samples of stored files tell: their number, SHA-256, the unsigned CRC-32 of the last 16, and a summary of
    their distribution (rows, distinct values, mean, deviation, entropy in bits, mean step)."""
    out = []
    for images in _decoded(media):
        samples = np.concatenate([(i >> np.uint32(8)).astype(np.uint8).reshape(-1) for i in images]) if images else np.zeros(0, np.uint8)
        raw = samples.tobytes()
        n = np.bincount(samples, minlength=256)
        p = n[n > 0] / max(1, len(samples))
        value = np.arange(256)
        mean = float((n * value).sum() / max(1, len(samples)))
        spread = float(np.sqrt(max(0.0, (n * (value - mean) ** 2).sum() / max(1, len(samples)))))
        step = float(np.abs(np.diff(samples.astype(np.int16))).mean()) if len(samples) > 1 else 0.0
        out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), f"rows={len(raw) // webp.WIDTH};values={len(p)};mean={mean:.4f};deviation={spread:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};step={step:.4f}"))
    return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def payload(text: Column) -> Column:
    """A text's UTF-8 bytes with spaces behind, up to a positive multiple of 192; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    size = F.octet_length(body)
    return F.concat(F.encode(body, "UTF-8"), F.encode(F.repeat(F.lit(" "), F.when(size == 0, 192).otherwise((192 - size % 192) % 192).cast("int")), "UTF-8"))


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each document of (doc_id, text): its payload as lossless WebP.

    Null and empty texts give 192 spaces; repeated rows give equal media; texts of any length are stored whole, over as
    many images as they take; an empty table gives an empty result; other columns are ignored.
    """
    rows = texts(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), payload(F.col("text")).alias("payload"))
    return rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")
