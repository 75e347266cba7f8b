"""Passages of 51 to 60 words inside other sentences are found wherever they stand."""

import random

import pytest

from lectern.llm import substring


def shared(a, b):
    """Whether two texts share a run of sentences or words."""
    return any(set(f(a)[0]) & set(f(b)[0]) for f in (substring.runs, substring.grams))


@pytest.mark.parametrize("few", [10**6, 400, 3, 1])
@pytest.mark.parametrize("mark", [0, 12])
def test_every_passage_over_50_words_shares_a_run(few, mark):
    rng = random.Random(few + mark)
    word = lambda n: f"w{rng.randrange(n)}" + ("." if mark and not rng.randrange(mark) else "")
    line = lambda n, kinds=10**6: " ".join(word(kinds) for _ in range(n))
    for n in range(51, 61):
        for _ in range(40):
            passage = line(n, few)
            a, b = (f"{line(rng.randrange(40))} {x} {line(rng.randrange(40))}" for x in (passage, passage.upper()))
            assert shared(a, b), (n, passage)


def test_chosen_runs_leave_no_window_out():
    rng = random.Random(4)
    for kinds in (1, 2, 5, 1000):
        for n in (26, 27, 60, 300):
            values = substring.np.array([rng.randrange(kinds) for _ in range(n)], substring.np.uint64)
            at = substring._chosen(values).tolist()
            for k in range(n - substring.WINDOW + 1):
                low = min(values[k:k + substring.WINDOW])
                assert any(values[p] == low for p in at if k <= p < k + substring.WINDOW)


def test_passages_inside_sentences_are_removed(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for k in range(60):
        passages.append(line(51 + k % 10))
        rows += [(2 * k, f"{line(k % 13)} {passages[k]} {line(20)}"), (2 * k + 1, f"{line(30)} {passages[k]} {line(k % 7)}")]
    rows += [(500, " ".join(["ha"] * 51)), (501, line(200))]
    old = dict(rows)
    for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id % 2 == 0 and r.doc_id < 500 or r.doc_id == 501:
            assert r.text == old[r.doc_id] and not r.removed
        elif r.doc_id < 500:
            own, left = passages[r.doc_id // 2].split(), set(r.text.split())
            assert r.removed and sum(w not in left for w in own) >= substring.GRAM
            assert {w for w in old[r.doc_id].split() if w not in own} <= left
        else:
            assert 26 <= len(r.text.split()) < 51 or r.text == old[500]


def test_only_runs_that_may_repeat_are_dealt_again(spark):
    """All rows of shared hashes pass, few of others do, and texts are dealt once."""
    rng = random.Random(8)
    line = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    each = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63), k) for k in range(20000)], "hash long, n int").cache()
    shared = substring.cut(each.where("n < 5000").select("hash"))
    got = {r.n for r in substring.marked(each, shared).collect()}
    assert got >= set(range(5000)) and len(got) < 5000 + 15000 / 8
    assert substring.marked(each, substring.cut(shared.where("false"))).count() == 0
    docs = spark.createDataFrame([(k, line(8000)) for k in range(40)], "doc_id long, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert substring.cleaned(docs).where("removed = 0").count() == 40
    sent = written() - before
    before = written()
    docs.repartition(2, "doc_id").write.format("noop").mode("overwrite").save()
    assert sent < 2 * (written() - before)


def test_cut_leaves_no_shuffle_files(spark):
    """Shuffles that made a cut table are gone when it stands."""
    files = lambda: sum(1 for m in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in m)
    spark.range(10).count()
    before = files()
    kept = substring.cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    assert files() == before and sorted(r.k for r in kept.collect()) == list(range(7))
