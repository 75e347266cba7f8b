"""Ranked search against scoring every document."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import search

WORD = re.compile(r"[^\W_]+")


def plain(docs, queries, k):
    said = {}
    for d, t in docs:
        if d is not None and t is not None:
            said.setdefault(d, []).extend(WORD.findall(t.lower()))
    mean = sum(map(len, said.values())) / len(said)
    df = {}
    for t in said.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, t in queries:
        scores = {}
        for w in sorted(set(WORD.findall((t or "").lower()))):
            for d, words in said.items():
                if tf := words.count(w):
                    scores[d] = scores.get(d, 0) + math.log(1 + (len(said) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, d, round(s, 6), r) for r, (d, s) in enumerate(best, 1)]
    return sorted(out)


def corpus(draw, n):
    vocabulary = [f"{a}{b}{c}" for a in ("über", "niño", "été", "the", "বই", "x") for b in "abcdefgh" for c in range(9)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i * 3 - 50, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 40)))) for i in range(n)], vocabulary


@pytest.mark.parametrize("width", [4, 128])
def test_best_documents_equal_a_scan(spark, tmp_path, width):
    draw = random.Random(3)
    docs, vocabulary = corpus(draw, 700)
    docs += [(-50, "the again ÜBER"), (None, "the"), (9000, None), (9001, ""), (9002, "12 !!"), (9003, "same words"), (9004, "same words")]
    queries = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 6)))) for i in range(40)] + [(100, "Same, same WORDS"), (101, ""), (102, None), (103, "nowhere"), (None, "the"), (104, "übera0 nowhere বইb3")]
    index = search.build(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, range string").repartition(4), width=width)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for k in (1, 7):
        got = sorted((r.query, r.doc, round(r.score, 6), r["rank"]) for r in search.search(index, asked, k).collect())
        assert got == plain(docs, [q for q in queries if q[0] is not None], k)
    index.save(str(tmp_path / "index"))
    again = search.Index.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, search.search(again, asked, 3).collect())) == sorted(map(tuple, search.search(index, asked, 3).collect()))


def test_ranges_that_cannot_win_are_skipped(spark):
    """A rare word decides; the common one alone stands nearly everywhere."""
    draw = random.Random(1)
    rows = [(i, " ".join(["common"] * draw.randrange(1, 3) + [f"w{draw.randrange(500)}" for _ in range(20)] + (["rare"] * 3 if i % 400 == 7 else []))) for i in range(4000)]
    index = search.build(spark.createDataFrame(rows, "doc_id long, text string"), width=16)
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    left = search.surviving(index, asked.select(F.col("query_id").alias("query"), F.explode(search.terms(F.col("text"))).alias("term")), 5).count()
    assert left <= 10 < index.blocks.where("term = 'common'").count() == 250
    assert [r.doc % 400 for r in search.search(index, asked, 5).collect()] == [7] * 5


def test_search_of_nothing(spark):
    index = search.build(spark.createDataFrame([], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert search.search(index, asked).collect() == []
    with pytest.raises(ValueError):
        search.search(index, asked, 0)


def test_index_of_asked_words_alone(spark):
    """Postings of the asked words only, with the scores that the index of all words gives."""
    draw = random.Random(12)
    docs = spark.createDataFrame([(draw.randrange(400), " ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 30)))) for _ in range(500)] + [(900, None), (None, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b b"), (2, "J zz"), (3, "")], "query_id long, text string")
    every, some = search.build(docs), search.build(docs, only=spark.createDataFrame([(w,) for w in ("a", "b", "j", "zz", "a")], "term string"))
    assert {r.term for r in every.tops.collect()} == set("abcdefghij") and {r.term for r in some.tops.collect()} == set("abj")
    assert {r.term for r in some.blocks.select("term").collect()} == set("abj")
    got, want = ([tuple(r) for r in search.search(i, asked, 10).orderBy("query", "rank").collect()] for i in (some, every))
    assert got == want and len(got) == 20
