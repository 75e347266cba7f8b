"""Operators on small tables where the test tables leave a case out, sources and streams."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import review, signatures, spatial, study
from lectern.sources import records
from lectern.streaming import queues


def test_hamming_pairs_equal_brute_force(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(62) for _ in range(6)]
    rows = [(i, centres[i % 6] ^ sum(1 << b for b in draw.sample(range(62), draw.randint(0, 9)))) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None)]
    first = {}
    for i, s in rows:
        if s is not None:
            first[s] = min(i, first.get(s, i))
    ids = sorted((i, s) for s, i in first.items())
    want = {(a, b, (x ^ y).bit_count()) for n, (a, x) in enumerate(ids) for b, y in ids[n + 1:] if (x ^ y).bit_count() <= 10}
    got = [tuple(r) for r in signatures.hamming_pairs(spark.createDataFrame(rows, "id long, s long"), "id", F.col("s"), 10).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_sign_bits(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(signatures.sign_bits("v")).collect()] == [9, 0, None]


def test_bootstrap_is_repeatable_and_holds_the_mean(spark):
    df = spark.createDataFrame([(f"f{i}", i / 10) for i in range(10)], "f string, v double")
    a, b = (study.bootstrap(df, "f", "v", 200).first() for _ in range(2))
    assert a == b and a.low < a.mean < a.high and abs(a.mean - 0.45) < 1e-12
    assert study.bootstrap(df.limit(0), "f", "v", 50).first().mean is None


def test_hamming_candidates_are_few(spark):
    """Random signatures of 64 bits meet under 1 % of the others, and every pair within the radius."""
    draw = random.Random(7)
    n = 3000
    sigs = [draw.getrandbits(64) - 2**63 for _ in range(n)]
    for i in range(200):  # near ones
        x = sigs[i]
        for k in draw.sample(range(63), draw.randrange(1, 12)):
            x ^= 1 << k
        sigs.append(x)
    df = spark.createDataFrame(list(enumerate(sigs)), "id long, sig long")
    met = signatures.hamming_candidates(df, 10, 64).where("id_a <> id_b").count()
    assert met < 0.01 * len(sigs) ** 2
    distance = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    want = {(i, j, d) for i in range(200) for j in range(n, n + 200) if (d := distance(sigs[i], sigs[j])) <= 10}
    got = {tuple(r) for r in signatures.hamming_pairs(df, "id", F.col("sig"), 10, 64).collect()}
    assert want <= got and all(distance(sigs[a], sigs[b]) == d <= 10 for a, b, d in got) and len(want) > 150
    edge, within, masks = signatures.near_masks(10, 64)
    assert edge == [0, 16, 32, 48, 64] and within == 2 and len(masks) == 137
    assert len(signatures.near_masks(20, 64)[2]) <= signatures.NEAR_KEYS


def test_records(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"name": "A", "productType": "book"}\n\n{broken\n{"name": " ", "productType": "book"}\n{"name": "B", "productType": "pen"}\n')
    found = records.json_lines(spark, str(tmp_path / "d.jsonl"))
    assert found.count() == 4 and found.where("_bad is not null").count() == 1
    assert [r.name for r in records.books(found).collect()] == ["A"]
    (tmp_path / "t.txt").write_text('/type/work\t/w/1\t3\t2020\t{"a": 1}\n{"b": 2}\n')
    assert sorted((r.kind or "", r.payload) for r in records.tab_dump(spark, str(tmp_path / "t.txt")).collect()) == [("", '{"b": 2}'), ("/type/work", '{"a": 1}')]


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = records.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, records.upsert(once, new, ["k"]).collect()))


def test_upsert_keeps_what_was_written_last(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "first", 1), (1, "last", 3), (1, "middle", 2), (None, "m", 1), (2, "tie a", 5), (2, "tie b", 5)], "k int, v string, at int").repartition(3)
    assert sorted(map(tuple, records.upsert(old, new, ["k"], "at").collect()), key=repr) == [(1, "last"), (2, "tie b"), (None, "m")]
    with pytest.raises(Exception, match="several new rows"):
        records.upsert(old, new.drop("at"), ["k"]).collect()


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "x", 1.0), (1, "2024-01-01 00:10:00", "x", 1.0), (2, "2024-01-01 01:20:00", "x", 2.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))

    def final(stream, name, mode):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    source = lambda: queues.events(spark, str(tmp_path / "in"), events.schema)
    assert sorted(r.event_id for r in final(queues.once(source(), "event_id"), "once_rows", "append")) == [1, 2]
    assert sorted((r.start.hour, r.n, r.total) for r in final(queues.windowed(source()), "windows", "complete")) == [(0, 2, 2.0), (1, 1, 2.0)]


def test_overlap_resolution_equals_a_plain_pass(spark):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), s := draw.randint(0, 400), s + draw.randint(1, 30), i) for i in range(150)]
    want = []
    for page in "ab":
        last = None
        for p, s, e, i in sorted((r for r in rows if r[0] == page), key=lambda r: r[1:]):
            if last is None or s >= last:
                want.append((p, s, e, i))
                last = e
    got = review.without_overlaps(spark.createDataFrame(rows, "page string, start int, end int, id int"), "page").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_spliced(spark):
    df = spark.sql("select 'the cat sat' as t, array(named_struct('start', 4, 'end', 7, 'before', 'cat', 'after', 'dogs'), named_struct('start', 0, 'end', 3, 'before', 'the', 'after', 'a')) as e")
    assert df.select(review.spliced(F.col("t"), F.col("e"))).first()[0] == "a dogs sat"


def test_text_helpers(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    draw = random.Random(7)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 90))) for _ in range(60)]
    pairs = list(zip(words, reversed(words)))
    assert all(text.common_length(a, b) == plain(a, b) for a, b in pairs)
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(text.indel_ratio("a", "b")).collect()] == [0.75, 1.0, None]
    row = spark.sql("select '4-6, 100,x,5' as p, 'Set 123 no. 07' as v, 'none' as w, ' b  A ' as s").select(text.page_ranges(F.col("p")), text.last_volume(F.col("v")), text.last_volume(F.col("w")), text.sorted_tokens(F.col("s"))).first()
    assert tuple(row) == ([4, 5, 6, 100], 7, None, "a b")


def test_boxes_equal_brute_force(spark):
    draw = random.Random(9)
    make = lambda n: [(draw.choice("pq"), i, x := draw.randint(-300, 900), y := draw.randint(-300, 900), x + draw.randint(0, 700), y + draw.randint(0, 700)) for i in range(n)]
    left, right = make(60), make(60)
    kind = "page string, id int, x0 int, y0 int, x1 int, y1 int"
    want = {(p, i, j, w * h) for p, i, a, b, c, d in left for q, j, e, f, g, k in right if p == q and (w := min(c, g) - max(a, e)) > 0 and (h := min(d, k) - max(b, f)) > 0}
    got = [(r.page, r.a, r.b, r.common) for r in spatial.overlaps(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), "page", "id").collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_rows_by_height_equal_a_plain_pass(spark):
    from statistics import median

    from lectern.operators import spatial

    data = [(p, i, i * 37 % 90, y, 60 + i, y + 10 + i % 5) for p in (1, 2) for i, y in enumerate([0, 3, 4, 5, 12, 40, 44, 46, 46, 90])]
    data.append((3, 0, 1, 1, 2, 2))
    got = {(r.page, r.id): r.row for r in spatial.rows_by_height(spark.createDataFrame(data, "page long, id long, x0 long, y0 long, x1 long, y1 long"), "page", "id").collect()}
    want = {}
    for page in (1, 2, 3):
        mine = sorted(((y0 + y1) / 2, x0, i) for p, i, x0, y0, _, y1 in data if p == page)
        tall, anchor, row = median(y1 - y0 for p, _, _, y0, _, y1 in data if p == page), None, -1
        for cy, _, i in mine:
            if anchor is None or cy - anchor >= tall / 2:
                anchor, row = cy, row + 1
            want[page, i] = row
    assert got == want


def test_core_pages_deal_books_before_they_have_pages(spark):
    """A window over all pages sorted them in as few tasks as the books' file has; the same rows, also where a key repeats."""
    import hashlib

    from lectern.operators import voting

    books = [(i, i * 7 % 40) for i in range(60)] + [(3, 15), (None, 4), (70, None), (71, -2)]
    found = voting.core_pages(spark.createDataFrame(books, "b long, n int").coalesce(1), "b", "n", 10, "pp")
    want = {}
    for b, n in books:
        for p in range(3, n - 1) if (n or 0) >= 12 else range(1, (n or 0) + 1):
            name = ":".join(str(x) for x in ("pp", b, p) if x is not None)
            want.setdefault(b, []).append((int(hashlib.md5(name.encode()).hexdigest()[:8], 16), p, n - 4 if n >= 12 else n))
    got = sorted((str(r.b), r.page, r.probability) for r in found.collect())
    assert got == sorted((str(b), p, round(min(1, 10 / n), 4)) for b, rows in want.items() for _, p, n in sorted(rows)[:10])
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_small_file_are_dealt(spark):
    """Queries that cost much for each row of a small file ran in as many tasks as the file has parts."""
    from lectern.plans import registry
    from lectern.plans import corpus, evaluation, keys  # noqa: F401  (they register their queries)

    for name in ("volume_vetoes", "disagreements_in_sql"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4, name
    plan = registry.QUERIES["pooled_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") + plan.count("Window [") >= 2, plan  # suppliers are cut by key before they meet customers


def test_pairs_are_scored_once(monkeypatch):
    from lectern.functions import scorers

    import pandas as pd
    from pyspark.sql import types as T

    calls = []
    scored = scorers._pairs(lambda a, b: calls.append((a, b)) or 1.0, T.DoubleType(), 64).func
    a, b = pd.Series(["x", None, "x", "y", "x" * 500, "x" * 500]), pd.Series(["z", "z", "z", "z", "w", "w"])
    assert [*scored(a, b)] == [1.0, None, 1.0, 1.0, 1.0, 1.0] and len(calls) == 4


def test_exact_pairs_are_no_fuzzy_candidates(spark):
    """A document's rows are dealt once, by id; the pairs of exact stages stay out of the pool without a join."""
    from lectern.operators import candidates

    docs = spark.createDataFrame([(1, "silver river vol 2", "ann", "i1"), (2, "silver river", None, None)], "id long, title string, author string, isbn string")
    editions = spark.createDataFrame([(k, t, a, i) for k, (t, a, i) in enumerate([("silver river vol 2", "Ann", None), ("silver rivers 2", "ann", "i1"), ("silver riven 2", "ann", None), ("silver river", "bob", None)])], "edition long, title string, author string, isbn string")
    found = candidates.generated(docs, editions)
    got = sorted((r.id, r.edition, r.method) for r in found.collect())
    assert len({x[:2] for x in got}) == len(got) and {x for x in got if x[2] != "fuzzy"} == {(1, 1, "exact_isbn"), (1, 0, "exact_title_author"), (2, 3, "exact_title")} and (1, 2, "fuzzy") in got
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2  # one more before


def test_equal_documents_are_scored_once(spark, monkeypatch):
    """Documents of one title, author and ISBN are one kind; its pairs are scored once, and each document takes its candidates,
    also where a kind's documents are dealt over parts. Two rows of one id are a kind of their own."""
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    from lectern.operators import candidates

    monkeypatch.setattr(candidates, "MEMBERS", 8)
    seen = spark.sparkContext.accumulator(0)

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([0.9] * len(a))

    score = score.asNondeterministic()  # else Spark runs it again for the filter on the scores
    rows = [(i, "silver river", "ann", None) for i in range(50)] + [(50, "silver river", "ann", None), (50, "silver road", "ann", None), (51, None, None, None)]
    docs = spark.createDataFrame(rows, "id long, title string, author string, isbn string")
    editions = spark.createDataFrame([(k, t, "bob", None) for k, t in enumerate(["silver rivers", "silver riven", "silver river"])], "edition long, title string, author string, isbn string")
    found = candidates.generated(docs, editions, title_score=score, author_score=lambda a, b: F.lit(1.0)).collect()
    near = [(i, k, "fuzzy") for i in range(51) for k in (0, 1)] + [(50, k, "fuzzy") for k in (0, 1)]
    assert sorted((r.id, r.edition, r.method) for r in found) == sorted(near + [(i, 2, "exact_title") for i in range(51)])
    assert seen.value == 2 + 4  # 104 before
    assert candidates.generated(docs, editions)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # 2 before
    nobody = spark.createDataFrame([(None, "silver river", "ann", None)], docs.schema)
    assert {(r.id, r.edition) for r in candidates.generated(nobody, editions, title_score=score, author_score=lambda a, b: F.lit(1.0)).collect()} == {(None, 0), (None, 1), (None, 2)}


def plain_candidates(docs, editions):
    """(id, edition, score, method) of all pairs of rows, one at a time."""
    import re
    from functools import lru_cache

    from lectern.functions import scorers

    of_titles, of_authors = lru_cache(None)(scorers.title_similarity), lru_cache(None)(scorers.best_of_sort_and_part)
    number = lambda t: int(found[-1]) if (found := re.findall(r"(?<!\d)\d{1,2}(?!\d)", t)) else None
    found = set()
    for i, title, author, isbn in docs:
        for k, name, by, code in editions:
            if isbn is not None and isbn == code:
                found.add((i, k, 1.0, "exact_isbn"))
            elif title is None or name is None:
                continue
            elif title.lower() == name.lower():
                same = author is not None and by is not None and author.lower() == by.lower()
                found.add((i, k, *((1.0, "exact_title_author") if same else (0.8, "exact_title"))))
            elif title.lower()[:8] == name.lower()[:8] or author is not None and author == by:
                t, known = of_titles(title.lower(), name.lower()), author is not None and by is not None
                a = of_authors(author.lower(), by.lower()) if known else 0.0
                v, w = number(title), number(name)
                score = 0.8 * t + 0.2 * a - (0 if v == w else 0.1 if v is None or w is None else 0.25)
                if t >= 0.55 and (not known or a >= 0.4) and score >= 0.55:
                    found.add((i, k, round(score, 9), "fuzzy"))
    numbered = {x[:2] for x in found if x[3] == "exact_isbn"}
    return {x for x in found if x[3] == "exact_isbn" or x[:2] not in numbered}


def test_no_candidate_is_cut(spark):
    """More editions than a pool has of one ISBN, one title, one prefix and one author: the classes' pairs and members stand for
    every pair of rows, in parts of any size; 100 of a pool and ten of a document stayed before."""
    from pyspark.sql import functions as F

    from lectern.operators import candidates

    docs = [(i, f"silver river {i % 3}", ["ann", "Ann", None][i % 3], "i1" if i % 4 == 0 else None) for i in range(12)]
    docs += [(12, "Silver Road", "ann", "i9"), (12, "golden gate 2", "bob", None), (13, None, "ann", None), (14, "golden gate", None, "i2"), (None, "silver road", "ann", "i1")]
    editions = [(k, f"silver river {k}", ["ann", "bob"][k % 2], None) for k in range(120)] + [(k, "silver road", "ann", "i1") for k in range(120, 240)]
    editions += [(k, f"golden gate{s}", a, "i2") for k, (s, a) in enumerate([("", "bob"), (" 2", "bob"), (" 3", None), ("s", "ann")], 240)] + [(244, None, "ann", None), (245, "silver river 1", "ann", "i9"), (None, "golden gate", "bob", None)]
    d, e = spark.createDataFrame(docs, "id long, title string, author string, isbn string"), spark.createDataFrame(editions, "edition long, title string, author string, isbn string")
    want = plain_candidates(docs, editions)
    assert sum(x[0] == 0 and x[3] == "exact_isbn" for x in want) == 120 and sum(x[0] == 2 and x[3] == "fuzzy" for x in want) > 100
    for block in (7, 4096):
        found = candidates.all_candidates(d, e, block=block)
        got = [tuple(r) for r in candidates.expanded(found).withColumn("score", F.round("score", 9)).collect()]
        assert set(got) == want and found.where("part = 'pair'").count() < len(want) / 4
    asked = spark.createDataFrame([(1,), (None,)], "id long")
    assert {tuple(r) for r in candidates.expanded(found, asked).withColumn("score", F.round("score", 9)).collect()} == {x for x in want if x[0] in (1, None)}


def test_scored_candidates_are_all(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from lectern.operators import candidates
    from lectern.plans import registry, resolve

    sf = "/root/testdata/sf0.01"
    docs, editions = ([tuple(r) for r in rows.collect()] for rows in resolve.sides(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")))
    got = [tuple(r) for r in candidates.expanded(registry.QUERIES["scored_candidates"](spark, sf)).withColumn("score", F.round("score", 9)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_candidates(docs, editions)
    assert max(Counter(x[0] for x in got if x[3] == "fuzzy").values()) > 10  # ten before
