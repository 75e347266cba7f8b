"""The pipeline's near-dedup against all pairs of five-word shingles."""

import random

from lectern.llm import neardup


def python_kept(rows):
    """doc_ids left by comparing all pairs of (doc_id, text)."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    return {min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def changed(words, rng, n):
    """A copy with words changed at n places far from each other: each place takes five shingles."""
    words, step = list(words), len(words) // n
    for k in range(n):
        words[k * step + step // 2] = f"new{rng.random()}"
    return words


def test_keeps_one_of_what_is_near_at_08(spark):
    rng, rows = random.Random(5), []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(10 * g + 1, " ".join(base)), (10 * g + 2, " ".join(changed(base, rng, 2 + g % 8)))]
    got = {r.doc_id for r in neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = python_kept(rows)
    assert got == want and 30 < len(want) < 60  # places: 2 to 9 of 196 shingles; up to 4 are near


def test_edges(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(changed(base, rng, 2))) for i in range(40)] + [(90, "Some  words"), (91, "some words"), (92, ""), (93, None), (94, "other words"), (None, "other words"), (92, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, root string, n int")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 90, 92, 94]
    assert neardup.keep_first(docs.where("false")).count() == 0
    assert [r.doc_id for r in neardup.keep_first(docs.where("doc_id is null and text is null")).collect()] == [None]
    several = spark.createDataFrame([(1, "one two three"), (1, "four five six"), (2, "one two three")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.keep_first(several).collect()) == [(1, "four five six"), (1, "one two three")]


def test_links_are_exact(spark):
    """100 shingles against 80 of them and against 79."""
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:84])), (3, " ".join(words[:83]))]
    for other, want in ((2, [1]), (3, [1, 3])):
        docs = spark.createDataFrame([rows[0], rows[other - 1]], "doc_id long, text string")
        assert sorted(r.doc_id for r in neardup.keep_first(docs).collect()) == want


def test_two_steps_deal_texts_once(spark):
    """The pipeline's near-dedup gives what its steps give one after the other, and shuffles whole texts once, not at each look at them."""
    import corpus_pipeline
    from lectern.llm import simhash

    rng, rows = random.Random(7), []
    for g in range(60):
        base = [f"{rng.getrandbits(60):x}" for _ in range(3000)]
        near = changed(base, rng, 60) if g % 4 else list(base)
        rows += [(2 * g, " ".join(base), g), (2 * g + 1 if g % 5 else None, " ".join(near), g)]
    rows += [(500, "", 1), (501, None, 2), (None, None, 3), (None, " ", 4), (500, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.createDataFrame([(1, "a", 1)], docs.schema).repartition(2).count()
    before = written()
    got = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    sent = written() - before
    assert got == sorted(map(str, neardup.keep_first(simhash.keep_first(docs, radius=3)).collect()))
    before = written()
    docs.repartition(2, "doc_id").write.format("noop").mode("overwrite").save()
    once = written() - before
    assert sent < 5 * once  # of which n-grams that are compared take over half
