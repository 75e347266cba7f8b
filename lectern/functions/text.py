"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^ -~]", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_view(text: Column) -> Column:
    """NFC with curly quotes folded and white space collapsed."""
    return collapsed(F.translate(nfc(text), "‘’“”", "''\"\""))


def line(text: Column) -> Column:
    """White space collapsed, and none before closing punctuation."""
    return collapsed(F.regexp_replace(text, r"\s+([,;:!?।])", "$1"))


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters, marks and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def without_tags(html: Column) -> Column:
    return collapsed(F.regexp_replace(html, "<[^>]+>", " "))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits by reference characters; null without a reference, 1 for an empty hypothesis."""
    return F.try_divide(F.levenshtein(reference, hypothesis).cast("double"), F.char_length(reference))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; 1 for two empty texts."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.char_length(a), F.char_length(b))), F.lit(1.0))


def portable_hash(text: Column) -> Column:
    """The first 32 bits of MD5 as a long: the same in other engines."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def isbn13(isbn10: Column) -> Column:
    """ISBN-13 of a ten-character ISBN with a right check character; null otherwise."""
    digit = lambda i: F.when(F.substring(isbn10, i, 1) == "X", 10).otherwise(F.substring(isbn10, i, 1).try_cast("int"))
    total = sum(((11 - i) * digit(i) for i in range(1, 11)), F.lit(0))
    body = F.concat(F.lit("978"), F.substring(isbn10, 1, 9))
    weighted = sum((F.substring(body, i, 1).try_cast("int") * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    good = isbn10.rlike("^[0-9]{9}[0-9X]$") & (total % 11 == 0)
    return F.when(good, F.concat(body, F.pmod(10 - weighted % 10, F.lit(10)).cast("string")))


def last_volume(title: Column) -> Column:
    """The last number of one or two digits that stands alone, without leading zeros; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(title, F.lit(r"(?<!\d)\d{1,2}(?!\d)"), F.lit(0)), F.lit(-1)).try_cast("int")


def page_ranges(given: Column) -> Column:
    """The sorted numbers of a list like ``4-13,100``; a null or malformed part has none."""
    part = lambda p, i: F.try_element_at(F.split(p, "-"), F.lit(i)).try_cast("int")
    numbers = F.transform(F.split(F.regexp_replace(given, r"\s", ""), ","), lambda p: F.when(part(p, 1) <= part(p, -1), F.sequence(part(p, 1), part(p, -1))))
    return F.array_sort(F.array_distinct(F.flatten(F.filter(numbers, lambda n: n.isNotNull()))))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence by both lengths; 1 for two empty texts, null if one is null."""
    return pd.Series([None if x is None or y is None else 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b)], dtype="float64")


def sorted_tokens(text: Column) -> Column:
    """Words in order, for comparing texts whatever their order of words."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")), " ")


def positional_similarity(a: Column, b: Column) -> Column:
    """Characters that agree in place, by the length of the longer; null for two empty texts."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != ""))
    return F.try_divide(F.size(F.filter(same, lambda s: s)).cast("double"), F.greatest(F.char_length(a), F.char_length(b)))


def first_integer(text: Column) -> Column:
    """The first run of ASCII digits as a long; null if there is none or it is too large."""
    return F.regexp_extract(text, "[0-9]+", 0).try_cast("long")
