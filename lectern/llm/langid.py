"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import broadcast_within, cut, texts

#: n-grams of 1 .. GRAMS characters, and how many of the most frequent make a profile.
GRAMS, PROFILE = 3, 400
SPACE = 32


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter (2), a mark inside words (1) or neither."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 2 if kind == "L" else kind == "M"
    return out


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a text's words, lower-cased and with a space before and behind each; none if the
    text has no letter. A code is the n-gram's code points, 21 bits each."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kind = _letters()[c]
    if not (kind == 2).any():
        return none
    c = np.where(kind > 0, c, SPACE)
    c = np.concatenate([[SPACE], c, [SPACE]]).astype(np.uint64)
    blank = c == SPACE
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
    grams, code = [c[c != SPACE]], c
    for n in range(1, GRAMS):
        code = (code[:-1] << np.uint64(21)) | c[n:]
        grams.append(code)
    grams = np.concatenate(grams)
    grams.sort()
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[edge], np.diff(np.append(edge, len(grams)))


def top(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first, ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:most]]  # codes come ascending


class Profiles:
    """Rank-order profiles of languages."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        self.codes = np.unique(np.array([c for x in ranked.values() for c in x], np.uint64))
        self.ranks = np.full((len(self.codes), len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(ranked[name], np.uint64)), k] = np.arange(len(ranked[name]))

    def near(self, text: str | None) -> tuple[str, float]:
        """(language, score): the smallest out-of-place distance, ties by name; the score is 1 for no distance and 0 for
        no common n-gram. ``und`` and 0 for a text without letters."""
        codes, counts = counted(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        mine = top(codes, counts)
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == mine
        place = np.flatnonzero(hit)[:, None]
        ranks = self.ranks[at[hit]]
        distance = np.where(ranks < 0, PROFILE, np.minimum(np.abs(ranks - place), PROFILE)).sum(0) + PROFILE * int((~hit).sum())
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (PROFILE * len(mine)))


def learn(docs: DataFrame, most: int = 5_000) -> Profiles:
    """Profiles from the text of rows with a non-null lang.

    Of a language with more than ``most`` rows, a share by hash of (doc_id, text) that is expected to hold ``most`` is read:
    a bounded sample of labelled rows, also where one text stands in very many of them. n-grams are counted in the tasks and summed by (language, n-gram); the top of each
    language is first found within hash buckets of n-grams, so the ranking never gathers all n-grams of a language.
    """
    named = texts(docs).where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("at"))
    share = cut(named.groupBy("lang").agg(F.least(F.lit(1.0), most / F.count("*")).alias("share")))
    sample = named.join(broadcast_within(share), "lang").where(F.pmod("at", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(counted(text.as_py()))
            for lang, many in held.items():
                codes, where = np.unique(np.concatenate([m[0] for m in many]), return_inverse=True)
                held[lang] = [(codes, np.bincount(where, np.concatenate([m[1] for m in many]), len(codes)).astype(np.int64))]
        for lang, [(codes, counts)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "n"])

    grams = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(64)))
    inside = Window.partitionBy("lang", "bucket").orderBy(F.desc("n"), "code")
    grams = grams.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= PROFILE)
    best = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= PROFILE)
    ranked: dict[str, list[int]] = {}
    for lang, code, _ in sorted(best.select("lang", "code", "r").collect(), key=lambda x: (x[0], x[2])):
        ranked.setdefault(lang, []).append(code)
    return Profiles(ranked)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone.

    Null text, and text without a letter, is ``und`` with score 0; so is every text if nothing was learned. Ties go to
    the smaller name. Repeated rows get equal answers; other columns are kept, but for columns of these two names, which
    are replaced; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def near(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.near(t) for t in column], columns=["lang_pred", "score"])

    return texts(docs).select(*[docs[c] for c in names], near(docs[text]).alias("_near")).select(*names, "_near.lang_pred", "_near.score")


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text is divisible by 5: a fifth of the rows that nothing is learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(5)) == 0


def identify(docs: DataFrame, most: int = 5_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each document of (doc_id, text, lang), learned from the rows not held out.

    Rows with null lang or text teach nothing and are still identified; null doc_ids count as an empty id; repeated rows
    get equal answers; an empty table gives an empty result; other columns are ignored.
    """
    out = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = learn(out.where("not held_out"), most)
    return predict(out.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.02, most: int = 5_000) -> DataFrame:
    """The documents in some learned language, with all columns: rejected are those without letters and those that share
    next to no n-grams with any profile (score below ``least``). Null and empty texts go; columns of any name and repeated
    rows are kept as they are; an empty table stays empty."""
    profiles = learn(docs.where(~held_out()), most)
    full = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return predict(full, profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
