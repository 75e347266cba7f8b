"""Similarity of texts and sequences: Arrow batches in, numbers out; and the same for single values."""

from __future__ import annotations

import difflib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.functions.text import common_length

#: Characters of a pair under which its score is kept.
SHORT = 400
#: Characters of a text up to which pairs are scored together, pairs that are, and scores that a task keeps.
WORD, TOGETHER, KEPT = 64, 1024, 1 << 16
#: The share of the longer title under which the shorter one is a fragment.
FRAGMENT = 0.7
OPS = T.StructType().add("edits", T.IntegerType()).add("inserts", T.IntegerType()).add("deletes", T.IntegerType()).add("replaces", T.IntegerType())


def ratio(a, b) -> float:
    """Twice the longest common subsequence by both lengths, of 100; 100 for two empty texts."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if len(a) or len(b) else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer of at most its length, also one cut off at an end."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    parts = {b[max(0, i):i + n] for i in range(1 - n, m)}
    best = max(ratio(a, p) for p in parts)
    return max(best, max(ratio(b, a[max(0, i):i + m]) for i in range(1 - m, n))) if n == m else best


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sorted_words(a), sorted_words(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and these with either text's other words; 100 if one text's words are all in
    the other, 0 if one has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    with_left, with_right = (" ".join([*both, *more]) for more in (left, right))
    best = ratio(with_left, with_right)
    return max(best, ratio(base, with_left), ratio(base, with_right)) if both else best


def best_of_sort_and_part(a: str, b: str) -> float:
    """The larger of token_sort_ratio and partial_ratio, of 1; 0 if one text is empty."""
    return max(token_sort_ratio(a, b), partial_ratio(a, b)) / 100 if a and b else 0.0


def title_similarity(a: str, b: str) -> float:
    """token_sort_ratio where one title is under 0.7 of the other's length, so that fragments do not pass; else the larger of
    it and partial_ratio."""
    if not a or not b:
        return 0.0
    if min(len(a), len(b)) / max(len(a), len(b)) < FRAGMENT:
        return token_sort_ratio(a, b) / 100
    return best_of_sort_and_part(a, b)


def _codes(texts: list[str], before: int = 0, behind: int = 0) -> np.ndarray:
    """Code points row by row; zeros before and behind."""
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), before + size.max() + behind), np.uint32)
    out[:, before:before + size.max()][np.arange(size.max()) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _best_ratios(a: list[str], b: list[str], parts: bool) -> np.ndarray:
    """``ratio`` of each text of ``a`` with that of ``b``, or with its best part of as many characters, also one cut off at an
    end. Texts have 1 to WORD characters. The rows of bits of all pairs and parts take each step together."""
    n, m = (np.array([len(t) for t in side]) for side in (a, b))
    wide = int(n.max()) if parts else 0
    left, right = _codes(a), _codes(b, wide, wide)
    place = np.arange(right.shape[1])
    inside = (place >= wide) & (place < wide + m[:, None])
    hits = np.zeros(right.shape, np.uint64)  # at a place of b: the bits of the places of a with its character
    for i in range(left.shape[1]):
        there = (right == left[:, i, None]) & inside & (i < n)[:, None]
        hits |= there.astype(np.uint64) << np.uint64(i)
    count = n + m - 1 if parts else np.ones(len(a), np.int64)
    first = np.cumsum(count) - count
    pair = np.repeat(np.arange(len(a)), count)
    start = np.arange(len(pair)) - first[pair] + (1 - n[pair] if parts else 0)
    size = n[pair] if parts else m[pair]
    full = ~np.uint64(0) >> (np.uint64(64) - n.astype(np.uint64))[pair]
    row, flat, at = full.copy(), hits.reshape(-1), pair * hits.shape[1] + wide + start
    for k in range(int(size.max())):
        hit = row & np.where(k < size, flat[np.minimum(at + k, len(flat) - 1)], np.uint64(0))
        row = (row + hit | row - hit) & full
    common = n[pair] - np.bitwise_count(row).astype(np.int64)
    length = np.minimum(m[pair], start + size) - np.maximum(0, start)
    return np.maximum.reduceat(200.0 * common / (n[pair] + length), first)


def _many(pairs: list[tuple[str, str]], whole: np.ndarray) -> np.ndarray:
    """What ``best_of_sort_and_part`` gives for pairs of texts of 1 to WORD characters; token_sort_ratio alone where ``whole``."""
    words = [(sorted_words(a), sorted_words(b)) for a, b in pairs]
    out = np.array([ratio(a, b) if not a or not b else 0.0 for a, b in words])
    if len(k := np.array([i for i, (a, b) in enumerate(words) if a and b], np.int64)):
        out[k] = _best_ratios(*map(list, zip(*(words[i] for i in k))), False)
    if len(k := np.flatnonzero(~whole)):
        short = [sorted(pairs[i], key=len) for i in k]
        best = _best_ratios(*map(list, zip(*short)), True)
        if len(same := np.array([j for j, (a, b) in enumerate(short) if len(a) == len(b)], np.int64)):
            best[same] = np.maximum(best[same], _best_ratios([short[j][1] for j in same], [short[j][0] for j in same], True))
        out[k] = np.maximum(out[k], best)
    return out / 100


def _trimmed(a, b):
    """Both sequences without what they share at either end."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    return a[start:len(a) - end], b[start:len(b) - end]


def _places(a) -> dict:
    """Element -> an integer whose bits are its places."""
    found: dict = {}
    for i, x in enumerate(a):
        found.setdefault(x, []).append(i)
    out = {}
    for x, at in found.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _columns(places: dict, full: int, b, up: int, down: int):
    """(up, down) for each element of ``b``, bit-parallel (Myers 1999, Hyyro 2003): the bits of the places of ``a`` at which the
    column of edit distances rises or falls by one. The whole column is one integer, so a step costs len(a) / 64 words."""
    for y in b:
        same = places.get(y, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(across | up)), up & across
        rise, fall = rise << 1 & full | 1, fall << 1 & full
        up, down = fall | (full & ~(level | rise)), rise & level
        yield up, down


def distance(a, b) -> int:
    """The fewest inserts, deletes and replaces that turn one sequence of any elements into the other."""
    a, b = _trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    full = (1 << len(a)) - 1
    up, down = full, 0
    for up, down in _columns(_places(a), full, b, full, 0):
        pass
    return len(b) + up.bit_count() - down.bit_count()


def edits(a, b) -> tuple[int, int, int, int]:
    """(edits, inserts, deletes, replaces) that turn ``a`` into ``b``, as few as can be; read from the end, of equal choices
    replacing comes first, then inserting.

    The way back through the table of distances needs every column. Each is two integers of len(a) bits; only every
    sqrt(len(b))-th is kept, and those between are made again when the way back comes to them, so 20,000 by 20,000 elements
    take a few megabytes instead of the table.
    """
    a, b = _trimmed(a, b)
    if not a or not b:
        return len(a) + len(b), len(b), len(a), 0
    places, full, n = _places(a), (1 << len(a)) - 1, len(b)
    step = math.isqrt(n) + 1
    kept = {0: (full, 0)}
    for j, column in enumerate(_columns(places, full, b, full, 0), 1):
        if not j % step:
            kept[j] = column
    i, j, ops = len(a), n, [0, 0, 0]
    first, columns = n + 1, []  # columns holds those from first on

    def column(j):
        nonlocal first, columns
        if j < first:
            first = j // step * step
            columns = [kept[first], *_columns(places, full, b[first:min(first + step, n)], *kept[first])]
        return columns[j - first]

    def value(j, i):
        """The distance of the first i elements of ``a`` and the first j of ``b``."""
        up, down = column(j)
        low = (1 << i) - 1
        return j + (up & low).bit_count() - (down & low).bit_count()

    here, left = value(n, i), value(n - 1, i)  # at (j, i) and at (j - 1, i)
    while i and j:
        up, down = column(j - 1)
        corner = left - (up >> (i - 1) & 1) + (down >> (i - 1) & 1)  # at (j - 1, i - 1)
        differ = a[i - 1] != b[j - 1]
        if here == corner + differ:
            ops[2] += differ
            i, j, here = i - 1, j - 1, corner
            left = value(j - 1, i) if j else 0
        elif here == left + 1:
            ops[0] += 1
            j, here = j - 1, left
            left = value(j - 1, i) if j else 0
        else:
            ops[1] += 1
            up, down = column(j)
            here += (down >> (i - 1) & 1) - (up >> (i - 1) & 1)
            i, left = i - 1, corner
    ops[0] += j
    ops[1] += i
    return sum(ops), *ops


def _pairs(score, kind, kept: int = 0):
    """``score`` of each row's pair, null if one is null; the last ``kept`` different pairs of short texts are scored once."""

    @pandas_udf(kind)
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        nonlocal known
        known = known or (lru_cache(kept)(score) if kept else score)
        return pd.Series([None if x is None or y is None else (known if len(x) + len(y) < SHORT else score)(x, y) for x, y in zip(a, b)], dtype=object)

    known = None
    return scored

    return scored


def _pairs_together(score, fragment: float):
    """``score`` of each row's pair, null if one is null. The different pairs of short texts of a batch are scored together, and a
    task keeps their scores; ``fragment`` is the share of the longer text under which the shorter one counts as no part.
    Spark makes a deterministic function again where a filter reads its column; this one is not declared so, and runs once a row."""
    known: dict[tuple[str, str], float] = {}

    @pandas_udf(T.DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = [None if x is None or y is None else (x, y) for x, y in zip(a, b)]
        if len(known) > KEPT:
            known.clear()
        new = [p for p in set(rows) if p is not None and p not in known]
        short = [p for p in new if 0 < len(p[0]) <= WORD and 0 < len(p[1]) <= WORD]
        for at in range(0, len(short), TOGETHER):
            part = short[at:at + TOGETHER]
            known.update(zip(part, _many(part, np.array([min(map(len, p)) / max(map(len, p)) < fragment for p in part])).tolist()))
        long = {p: score(*p) for p in new if p not in known}
        return pd.Series([None if p is None else known[p] if p in known else long[p] for p in rows], dtype=object)

    return scored.asNondeterministic()


fuzz_ratio, fuzz_partial, fuzz_token_sort, fuzz_token_set = (_pairs(f, T.DoubleType()) for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio))
match_score, title_score = _pairs_together(best_of_sort_and_part, 0.0), _pairs_together(title_similarity, FRAGMENT)
difflib_ratio = _pairs(lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), T.DoubleType())
sequence_distance = _pairs(lambda a, b: distance(list(a), list(b)), T.IntegerType())
grapheme_distance = _pairs(lambda a, b: distance(regex.findall(r"\X", a), regex.findall(r"\X", b)), T.IntegerType())
_long_distance = _pairs(distance, T.IntegerType())
#: Cells of the table of distances up to which the built-in function, which fills it, is the faster one.
CELLS = 1 << 20


def char_distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts by characters: the built-in function for short texts, bit-parallel for long ones; null if
    one is null."""
    small = F.char_length(a).cast("long") * F.char_length(b) <= CELLS
    return F.when(small, F.levenshtein(F.when(small, a), F.when(small, b))).otherwise(_long_distance(F.when(~small, a), F.when(~small, b)))


@pandas_udf(OPS)
def edit_operations(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Fewest edits from the first text to the second, by kind; null counts as empty."""
    return pd.DataFrame([edits(x or "", y or "") for x, y in zip(a, b)], columns=["edits", "inserts", "deletes", "replaces"])


def jaccard_estimate(a: Column, b: Column) -> Column:
    """The share of positions at which two signatures agree; 0 for signatures of different length or without positions."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")
