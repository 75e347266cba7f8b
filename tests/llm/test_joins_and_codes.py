"""N-gram join, divergence audit and vector codes against plain versions, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import divergence, ngram_join, vector_codes

# --- N-gram join


def plain_components(rows, width=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def chains(seed, groups=4, members=30, words=60):
    """Near copies of near copies, so that many are linked over others alone."""
    draw, out = random.Random(seed), []
    for _ in range(groups):
        first = last = [f"w{draw.randrange(10**6)}" for _ in range(words)]
        for _ in range(members):
            last = list(first if draw.random() < 0.5 else last)
            for _ in range(draw.randint(0, 3)):
                last[draw.randrange(words)] = f"q{draw.randrange(10**6)}"
            out.append(" ".join(last))
    return out


@pytest.mark.parametrize("stars", [1, 3])
def test_join_equals_all_pairs(spark, stars):
    near = chains(stars)
    odd = [None, "", " \n", "Solo Text", "solo  text", "a b c d e", "a b c d", "x " * 9000, "x " * 20, near[0], near[1].upper()]
    rows = [*enumerate(near), *((1000 + i, t) for i, t in enumerate(odd)), (None, near[2]), (3, near[40]), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    assert sorted(map(tuple, ngram_join.similar_texts(df, stars=stars).collect()), key=repr) == plain_components(rows)


def test_join_of_nothing(spark):
    assert ngram_join.similar_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in ngram_join.similar_texts(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def test_join_compares_a_group_with_few_of_its_members(spark):
    """A group of 400 near copies gives some pairs a member, not 80,000."""
    draw = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, [*base[:k], f"q{i}", *base[k + 1:]]) for i in range(400) for k in [draw.randrange(200)]]
    counted = []
    plain = ngram_join.overlaps

    def counting(pairs, segments):
        counted.append(pairs.count())
        return plain(pairs, segments)

    ngram_join.overlaps = counting
    try:
        found = ngram_join.similar_texts(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
        assert {r.component_id for r in found.collect()} == {0} and sum(counted) < 400 * 8
    finally:
        ngram_join.overlaps = plain


def test_grams_are_distinct_sets():
    assert len(ngram_join.grams("A b c d e f")) == 2 and len(ngram_join.grams("a")) == 1 and not len(ngram_join.grams("\t "))
    assert len(ngram_join.grams("a b c d e a b c d e")) == 5
    assert ngram_join.grams("a b")[0] != ngram_join.grams("b a")[0] and ngram_join.grams("a b c d")[0] != ngram_join.grams("a b c d x")[0]


# --- Divergence


def plain_audit(rows, least=10, top=10):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    uses, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = word.findall((text or "").translate(lower))
        uses.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang, source in groups:
        kept = [t for (la, t), n in docs.items() if la == lang and n >= least]
        names = [s for la, s in groups if la == lang]
        total = {s: sum(uses[lang, s, t] for t in kept) for s in names}
        share = lambda n, whole: 1 + 1000000000 * (n + 2) // (whole + 2 * len(kept))
        p = {s: {t: share(uses[lang, s, t], total[s]) for t in kept} for s in names}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(s, sum(f(p[source][t], p[s][t]) for t in kept)) for s in names if s != source]
        q = {t: share(sum(uses[lang, s, t] for s in names), sum(total.values())) for t in kept}
        terms = [(t, f(p[source][t], q[t])) for t in kept if uses[lang, source, t] and p[source][t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def test_audit_equals_plain(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdeéß語Z" for b in "xyzwv"]
    rows = [(draw.choice(["en", "de", None]), f"s{draw.randrange(7)}", " ".join(draw.choices(vocabulary, k=draw.randrange(40)))) for _ in range(400)]
    rows += [("en", None, "ax ax, AX"), ("xx", "alone", "ax"), ("xx", "b", None), ("xx", "b", ""), ("yy", "only", "q " * 30), ("zz", "é", "1 2 3"), ("zz", "z", "rare")] + [("yy", "only", "q1q")] * 12
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int").repartition(4)
    want = plain_audit(rows)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    small = lambda kept, groups: plain(kept, groups, block=2, chunk=7, span=2)
    plain = divergence.pair_divergence
    monkeypatch.setattr(divergence, "pair_divergence", small)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want


def test_audit_of_nothing_and_large_counts(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    for count, total in ((2 * 10**14, 28 * 10**13), (3, 10**14), (7, 7), (2, 10**9 + 7)):
        assert divergence.share(count, total) == divergence.share(np.int64(count), np.int64(total)) == 1 + 10**9 * count // total


# --- Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(scale * Fraction(v)) for v in r[1]] for r in rows]
    w = -(-len(x[0]) // parts)
    cutup = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in x]
    books = [[v[p] for v in cutup[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: far(v[p], books[p][e])) for p in range(parts)] for v in cutup]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(cutup, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    codes = assign()
    out = [(r[0], "".join(f"{c:02x}" for c in code), sum(far(v[p], books[p][code[p]]) for p in range(parts))) for r, v, code in zip(rows, cutup, codes)]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def coded(spark, rows, kind="array<double>", **options):
    df = spark.createDataFrame([(*r, r[0] and r[0] % 3, 9) for r in rows], f"vec_id long, embedding {kind}, label int, error int").repartition(3)
    found, books = vector_codes.compress(df, **options)
    return sorted(((r.key, r.code, r.error) for r in found.collect()), key=repr), books, found


def test_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 70)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.05 * draw.normal(size=16)).tolist()) for i in range(500)]
    rows += [(600 + i, [0.25] * 16) for i in range(20)] + [(None, [0.5] * 16), (5, [0.125] * 16), (7, rows[7][1])]
    want, digest = plain_codes(rows)
    trace = []
    got, books, found = coded(spark, rows + [(700, None), (701, [None] + [1.0] * 15), (702, [float("nan")] * 16), (703, [float("inf")] * 16), (704, [1.0] * 7)], trace=trace)
    assert got == want and books.digest() == digest
    assert trace[0] == 8 * len(rows) and trace[-1] < 0.5 * trace[0]  # slack spares parts their scans
    sums = Counter()
    for r in found.collect():
        sums[r.label] += r.error
    labelled = vector_codes.with_label_errors(found).collect()
    assert len(labelled) == len(rows) and all(r.label_error == sums[r.label] for r in labelled)


def test_codes_of_huge_and_few_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 1.0, -1e30, 3e300, 1e306, 0.5]) for _ in range(8)]) for i in range(60)]
    want, digest = plain_codes(rows, 4, 5, 3)
    got, books, found = coded(spark, rows, parts=4, entries=5, rounds=3)
    assert books.digest() == digest and got == sorted(((k, c, e if e < 2**63 else None) for k, c, e in want), key=repr)
    assert all(r.label_error is None for r in vector_codes.with_label_errors(found).collect())
    want, digest = plain_codes(rows[:3])
    got, books, _ = coded(spark, rows[:3])
    assert books.digest() == digest and [g[:2] for g in got] == [w[:2] for w in want]
    five = [(i, [float(i), 0.5, -1.0, 2.0, i / 3]) for i in range(40)]  # parts do not divide the length
    got, books, _ = coded(spark, five, kind="array<float>", parts=2)
    assert len(got) == 40 and [len(b[0]) for b in books.entries] == [3, 2]
    got, books, _ = coded(spark, [(1, None)])
    assert got == [] and books.entries == [[]] * 8


def test_heap_pops_by_drift():
    heaps = vector_codes.Heaps(2)
    heaps.push(1, np.array([1.0, 2.0, 5.0], "<f4"), np.array([4, 3, 9], np.uint16))
    heaps.push(1, np.array([0.5, 6.0], "<f4"), np.array([1, 2], np.uint16))
    heaps = vector_codes.Heaps.load(2, *heaps.dump())
    assert sorted(heaps.pop(1, 2.0)) == [1, 3, 4] and not len(heaps.pop(0, 9.0)) and sorted(heaps.pop(1, 9.0)) == [2, 9] and heaps.runs == [[], []]
