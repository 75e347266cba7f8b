"""Text links, fuzzy lookup, families and plans of moves against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import scorers
from lectern.operators import candidates, corpus, dedupe, textlsh, voting
from lectern.streaming import jobs


def plain_signature(view):
    """Place by place, with Python's integers."""
    hashes = {sum(ord(c) * 1099511628211**j for j, c in enumerate(view[i:i + 9])) % 2**64 for i in range(len(view) - 8)}
    low = {}
    for h in hashes:
        z = h * textlsh.SPREAD % 2**64
        low[z >> 57] = min(z % 2**57 >> 25, low.get(z >> 57, 2**32))
    if not low:
        return [0] * 128
    return [next(low[(j + k) % 128] + (k << 32) for k in range(128) if (j + k) % 128 in low) for j in range(128)]


def near_texts(draw):
    base = [[f"word{draw.randrange(400)}" for _ in range(220)] for _ in range(6)]
    rows = []
    for i in range(72):
        words = list(base[i % 6])
        for _ in range(draw.randrange(0, 7)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows + [(100 + i, rows[0][1].upper() + " !") for i in range(5)] + [(200, "short"), (201, None), (202, ""), (None, rows[0][1])]


def test_signatures_equal_plain_ones(spark):
    rows = [(1, "Héllo wörld, again"), (2, "ab"), (3, None), (4, "x" * 50), (5, " ".join(str(i) for i in range(400)))]
    got = {r.doc_id: (r.shingles, r.signature) for r in textlsh.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        view = " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c == " ").split())
        assert got[i] == (len({view[k:k + 9] for k in range(len(view) - 8)}), plain_signature(view))


def test_text_links_equal_all_pairs(spark):
    rows = near_texts(random.Random(3))
    signed = textlsh.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = {r.doc_id: tuple(r.signature) for r in signed.collect() if r.doc_id is not None and r.shingles >= 500}
    classes = {}
    for i in sorted(plain):
        classes.setdefault(plain[i], []).append(i)
    root = {m[0]: m[0] for m in classes.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for x in root:
        for y in root:
            same = np.array(plain[x]) == np.array(plain[y])
            if x < y and same.mean() >= 0.75 and same.reshape(16, 8).all(1).any():
                pairs.add((x, y))
                root[max(find(x), find(y))] = min(find(x), find(y))
    want = {i: (m[0], len(m), find(m[0])) for m in classes.values() for i in m}
    assert len(pairs) > 50 and len(set(v[2] for v in want.values())) >= 6
    for stars in (1, 3):
        assert {r.doc_id: (r.class_id, r.members, r.family) for r in textlsh.text_links(signed, stars=stars).collect()} == want
    edges = textlsh.text_edges(signed).collect()
    assert {(r.a, r.b) for r in edges if r.score < 1} <= pairs and sum(r.score == 1 for r in edges) == sum(len(m) - 1 for m in classes.values())


def test_permuted_signatures_and_numbers_of_links_equal_all_pairs(spark):
    """128 permutations of each shingle, and every link of a class, also where a bucket is cut into parts."""
    rows = near_texts(random.Random(3))
    signed = textlsh.permuted_signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r for r in signed.collect() if r.doc_id is not None}
    a, b = ([int(v) for v in c] for c in textlsh.coefficients())
    view = dict(rows)[0]
    own = {sum(ord(c) * 1099511628211**j for j, c in enumerate(view[i:i + 9])) % 2**64 for i in range(len(view) - 8)}
    assert found[0].signature == [min((h % (2**31 - 1) * x + y) % (2**31 - 1) for h in own) for x, y in zip(a, b)] and found[0].shingles == len(own)
    assert found[200].signature == found[201].signature == [0] * 128
    plain = {i: tuple(r.signature) for i, r in found.items() if r.shingles >= 500}
    classes = {}
    for i in sorted(plain):
        classes.setdefault(plain[i], []).append(i)
    near = lambda x, y: (s := np.array(x) == np.array(y)).mean() >= 0.75 and s.reshape(16, 8).all(1).any()
    links = {x: sum(near(x, y) for y in classes) - 1 for x in classes}
    want = {i: (m[0], len(m), links[x]) for x, m in classes.items() for i in m}
    assert sum(links.values()) > 100
    for block in (4096, 5):
        assert {r.doc_id: (r.class_id, r.members, r.links) for r in textlsh.counted_links(signed, block=block).collect()} == want


def test_links_find_similar_texts(spark):
    """Of all pairs of texts whose shingles are 0.8 alike or more, over 95 % end in one family; none that are under 0.6 alike."""
    draw = random.Random(12)
    rows = []
    for g in range(40):
        base = [f"w{draw.randrange(10**5)}" for _ in range(300)]
        rows.append((2 * g, " ".join(base)))
        for k in draw.sample(range(300), draw.randrange(1, 110)):
            base[k] = f"n{draw.randrange(10**5)}"
        rows.append((2 * g + 1, " ".join(base)))
    family = {r.doc_id: r.family for r in textlsh.text_links(textlsh.signatures(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    sets = [{t[k:k + 9] for k in range(len(t) - 8)} for _, t in rows]
    alike = [(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]), family[i] == family[i + 1]) for i in range(0, 80, 2)]
    near, far = [hit for s, hit in alike if s >= 0.8], [hit for s, hit in alike if s < 0.6]
    assert len(near) > 2 and len(far) > 8 and sum(near) >= 0.95 * len(near) and not any(far)


def test_a_large_bucket_costs_a_comparison_a_class(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 32, 128)
    rows = []
    for i in range(4000):
        own = base.copy()
        own[draw.integers(8, 128, 12)] = draw.integers(0, 1 << 32, 12)  # the first band is everybody's
        rows.append((i, own.tolist()))
    compared = []
    plain = textlsh._measured
    monkeypatch.setattr(textlsh, "_measured", lambda pairs, classes: (compared.append(pairs.count()), plain(pairs, classes))[1])
    classes = spark.createDataFrame(rows, "class_id long, signature array<long>")
    links = textlsh.class_links(classes).collect()
    assert len({r.b for r in links} | {r.a for r in links}) == 4000 and sum(compared) < 40 * 4000


def test_fuzzy_lookup_equals_all_pairs(spark):
    draw = random.Random(8)
    say = lambda: "".join(draw.choice("abcd ") for _ in range(draw.randint(1, 25)))
    entries = [(i, say()) for i in range(150)]
    asked = [(i, "".join(c for c in draw.choice(entries)[1] if draw.random() > 0.06) + draw.choice(["", "x"])) for i in range(150)] + [(900, ""), (901, None)]
    want = {}
    for i, q in asked:
        if q:
            score, entry = max((scorers.ratio(q, k), -e) for e, k in entries if k)
            if score >= 88:
                want[i] = (-entry, score)
    got = {r.id: (r.entry, r.score) for r in corpus.fuzzy_lookup(spark.createDataFrame(asked, "id long, key string"), spark.createDataFrame(entries, "entry long, key string")).collect()}
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(np.isclose(got[i][1], want[i][1]) and got[i][0] == want[i][0] for i in want)


def test_vetoes_and_relations(spark):
    facts = spark.createDataFrame([(1, "Set vol 1", "first long title"), (2, "Set vol 2", "first long title"), (3, "Set", "first long title"), (4, "Set vol 1", "zzzzzzzzzz"), (5, "Set vol 01", "title long first")], "doc_id long, name string, title string")
    edges = spark.createDataFrame([(1, 2, "sha256"), (1, 3, "sha256"), (1, 4, "page_image"), (1, 5, "sha256"), (1, 2, "metadata_exact")], "a long, b long, method string")
    assert {(r.b, r.method): r.vetoed for r in dedupe.vetoed(edges, facts).collect()} == {(2, "sha256"): True, (3, "sha256"): True, (4, "page_image"): True, (5, "sha256"): False, (2, "metadata_exact"): False}
    media = spark.createDataFrame([(1, "pdf"), (2, "pdf"), (3, "epub"), (4, None)], "doc_id long, media string")
    kinds = spark.createDataFrame([(2, 1, "sha256"), (1, 3, "sha256"), (1, 4, "sha256"), (1, 2, "text_minhash"), (1, 3, "text_minhash"), (1, 3, "metadata_fuzzy")], "a long, b long, method string")
    assert sorted((r.a, r.b, r.method, r.relation) for r in dedupe.typed(kinds, media).collect()) == [(1, 2, "sha256", "duplicate"), (1, 2, "text_minhash", "same_work"), (1, 3, "metadata_fuzzy", "same_work"), (1, 3, "sha256", "format_variant"), (1, 3, "text_minhash", "format_variant"), (1, 4, "sha256", "same_work")]


def test_reviews_take_one_match_a_document(spark):
    matches = spark.createDataFrame([(1, 10, "candidate"), (2, 10, "candidate"), (3, 11, "accepted"), (4, 11, "candidate"), (5, 12, "candidate")], "id long, document long, status string")
    decisions = spark.createDataFrame([(1, "accepted"), (2, "accepted"), (4, "accepted"), (5, "rejected"), (3, "rejected")], "id long, decision string")
    assert {r.id: r.status for r in candidates.reviewed(matches, decisions).collect()} == {1: "accepted", 2: "candidate", 3: "accepted", 4: "candidate", 5: "rejected"}


def test_open_conflicts_are_errors_in_final_texts(spark):
    import pytest

    status = spark.createDataFrame([(1, 1, "conflict", "")], "page long, region long, status string, agreed string")
    none = spark.createDataFrame([], "page long, region long, text string, revision int")
    with pytest.raises(Exception, match="an open conflict"):
        voting.final_texts(status, none).collect()


def test_a_file_settles_over_polls(spark):
    state = spark.createDataFrame([], "path string, size long, mtime long, since long")
    seen = lambda size: spark.createDataFrame([("f", size, 1)], "path string, size long, mtime long")
    ready = []
    for now, size in ((0, 5), (60, 6), (100, 6), (180, 6), (200, 7), (400, 7)):
        polled = jobs.poll(state, seen(size), F.lit(now).cast("long"))
        ready.append(polled.first().ready)
        state = spark.createDataFrame(polled.select("path", "size", "mtime", "since").collect(), state.schema)
    assert ready == [False, False, False, True, False, True]
    gone = jobs.poll(state, seen(1).limit(0), F.lit(900).cast("long")).first()
    assert (gone.present, gone.ready, gone.since) == (False, False, 200)


def test_texts_are_signed_once(spark):
    """A filter on the number of shingles takes no further pass of Python over the texts: one normalises, one signs."""
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for sign in (textlsh.signatures, textlsh.permuted_signatures):
        usable = sign(docs).where((F.col("shingles") >= 1) & F.col("doc_id").isNotNull()).select("doc_id", "signature")
        plan = usable._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2, plan
        assert [r.doc_id for r in usable.collect()] == [1]


def test_counted_links_have_families(spark):
    """Each text has the smallest class that it reaches over links, also over others and where a bucket is cut into parts, beside
    its number of links; two parts give fewer links than they have rows to connect them."""
    draw = random.Random(5)
    rows, words = near_texts(draw), [f"w{draw.randrange(10**5, 10**6)}" for _ in range(400)]
    for k in range(6):  # each text is near the next, the first not near the last
        rows.append((1000 + k, " ".join(words)))
        words[k::25] = [f"n{draw.randrange(10**5, 10**6)}" for _ in range(16)]
    signed = textlsh.permuted_signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = {r.doc_id: tuple(r.signature) for r in signed.collect() if r.doc_id is not None and r.shingles >= 500}
    classes = {}
    for i in sorted(plain):
        classes.setdefault(plain[i], []).append(i)
    near = lambda x, y: x != y and (s := np.array(x) == np.array(y)).mean() >= 0.75 and s.reshape(16, 8).all(1).any()
    links = {x: [y for y in classes if near(x, y)] for x in classes}
    want, seen = {}, set()
    for x in sorted(classes, key=lambda x: classes[x][0]):
        reached, ahead = {x}, [x]
        while ahead:
            ahead = [y for y in links[ahead.pop()] if y not in reached] + ahead
            reached.update(ahead)
        want |= {i: (classes[x][0], len(classes[x]), len(links[x]), min(classes[y][0] for y in reached)) for i in classes[x]}
        seen.add(len(reached) > len(links[x]) + 1)
    assert seen == {True, False} and len({v[3] for v in want.values()}) >= 6
    for block in (4096, 5):
        assert {r.doc_id: (r.class_id, r.members, r.links, r.family) for r in textlsh.counted_links(signed, block=block).collect()} == want
    marks = np.zeros((300, 128), np.int64)
    mine, theirs, edges = textlsh._near(marks, marks[:200], 0, 0.75, 16, False)
    assert set(mine) == {200} and set(theirs) == {300} and len(edges) == 499  # 60,000 links
