"""Scorers, lines, models and folds against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import filenames, keys, scorers
from lectern.operators import dedupe, evaluation, spatial, voting


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_scorers_equal_plain_versions():
    draw = random.Random(4)
    say = lambda n: "".join(draw.choice("abc ") for _ in range(draw.randint(0, n)))
    ratio = lambda a, b: 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
    for _ in range(300):
        a, b = say(14), say(20)
        edits, more, less, other = scorers.edits(a, b)
        assert edits == plain_distance(a, b) == more + less + other and more - less == len(b) - len(a)
        assert scorers.edits(a.split(), b.split())[0] == plain_distance(a.split(), b.split())
        assert scorers.ratio(a, b) == pytest.approx(ratio(a, b))
        assert scorers.token_sort_ratio(a, b) == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
        short, long = sorted((a, b), key=len)
        if short:
            windows = [long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long)))]
            best = max(ratio(short, w) for w in windows)
            if len(a) == len(b):
                best = max(best, max(ratio(long, short[i:j]) for i in range(len(short)) for j in range(i + 1, len(short) + 1) if i == 0 or j == len(short)))
            assert scorers.partial_ratio(a, b) == pytest.approx(best)
    assert scorers.token_set_ratio("a b c", "c b") == 100 and scorers.token_set_ratio("", "a") == 0
    assert scorers.title_similarity("abcdef", "ab") == scorers.token_sort_ratio("abcdef", "ab") / 100


def test_lines_are_matched_as_by_a_plain_pass():
    draw = random.Random(6)
    say = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(0, 6)))
    near = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else 1 - plain_distance(a, b) / max(len(a), len(b))
    for _ in range(200):
        census, found = [say() for _ in range(5)], [say() for _ in range(5)]
        used = set()
        for line in census:
            scores = [(near(line, o), -j) for j, o in enumerate(found) if j not in used]
            best, at = max(scores, default=(0, 0))
            if best >= 0.7:
                used.add(-at)
        assert evaluation.match_lines(census, found) == (len(used), 5 - len(used), 5 - len(used))


def test_logistic_equals_row_by_row_descent(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 4, (120, 2)).astype(float)
    y = (x[:, 0] + draw.normal(size=120) > 2).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    model = evaluation.fit_logistic(df, ["a", "b"], F.col("y"), steps=100)
    z, w, bias = (x - x.mean(0)) / x.std(0), np.zeros(2), 0.0
    for _ in range(100):
        off = 1 / (1 + np.exp(-(z @ w + bias))) - y
        w, bias = w - 0.1 * (off @ z / 120 + w / 120), bias - 0.1 * off.mean()
    assert np.allclose(model.weights, w) and np.isclose(model.bias, bias)
    got = np.array([r[0] for r in df.select(model.probability()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-(z @ w + bias))))


def test_errors_are_raised(spark):
    rows = spark.createDataFrame([("f", 0.1), ("g", 0.2)], "family string, v double")
    with pytest.raises(Exception, match="no pair for family g"):
        evaluation.effects(rows, rows.limit(1)).collect()
    with pytest.raises(Exception, match="a reference without text"):
        evaluation.scored(spark.createDataFrame([(" ", "x")], "r string, h string"), "r", "h").collect()
    refs = spark.createDataFrame([(1, "a", "page"), (2, "b", "line")], "id int, reference string, level string")
    with pytest.raises(Exception, match="several levels"):
        evaluation.evaluated(refs, spark.createDataFrame([(1, "a")], "id int, hypothesis string")).collect()


def plain_draw(rows, cells, per_cell, per_author, seed="s"):
    import hashlib

    order = lambda r: (int(hashlib.md5(f"{seed}:{r[1]}:{r[0]}".encode()).hexdigest()[:8], 16), r[0])
    taken, full, want = set(), {}, []
    for target, *spare in cells:
        mine = 0
        for cell in [target, *spare]:
            for r in sorted((r for r in rows if r[1] == cell and r[2] not in ("unknown", None)), key=order):
                if mine < per_cell and r[0] not in taken and full.get(r[2], 0) < per_author:
                    taken.add(r[0])
                    full[r[2]] = full.get(r[2], 0) + 1
                    mine += 1
                    want.append((target, r[0], mine))
    return want


def test_arms_rebuilt_from_stored_predictions(spark, tmp_path):
    import json

    lines = [{"arm_id": "a", "family": "f", "reference": "cafe\u0301", "hypothesis": "café"}, {"arm_id": "a", "family": "g", "reference": "abcd", "hypothesis": "abxd", "accepted": True, "edit_class": "harmful", "exact": False},
             {"arm_id": "a", "family": "g", "reference": "ab", "accepted": False, "status": "failed"}, {"arm_id": "b", "family": "f", "reference": "x", "hypothesis": "x", "status": "unsupported"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "arm string")
    got = {r.arm: r for r in evaluation.arms(evaluation.stored_records(spark, str(tmp_path / "r.jsonl")), roster).collect()}
    assert got["a"].macro_cer == (0 + (0.25 + 1) / 2) / 2 and (got["a"].status, got["a"].attempted, got["a"].accepted, got["a"].harmful) == ("failed", 3, 1, 1)
    assert got["b"].status == "unsupported" and got["b"].macro_cer == 0 and got["c"].status == "failed" and got["c"].attempted == 0
    for broken, problem in (("{oops", "no JSON"), ('{"arm_id": "a", "family": "f"}', "without arm"), ('{"arm_id": "a", "family": "f", "reference": "x", "accepted": true}', "without a class")):
        (tmp_path / "x.jsonl").write_text(broken)
        with pytest.raises(Exception, match=problem):
            evaluation.arms(evaluation.stored_records(spark, str(tmp_path / "x.jsonl")), roster).collect()


def plain_script(a, b):
    """The way back through the whole table: replace before insert before delete, behind what both ends share."""
    start = end = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        last, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        rows.append(row)
    i, j, ops = len(a), len(b), [0, 0, 0]
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j, ops[2] = i - 1, j - 1, ops[2] + (a[i - 1] != b[j - 1])
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j, ops[0] = j - 1, ops[0] + 1
        else:
            i, ops[1] = i - 1, ops[1] + 1
    return sum(ops), *ops


def test_edit_scripts_equal_the_whole_table():
    draw = random.Random(9)
    for _ in range(600):
        a, b = ("".join(draw.choice("abcd"[:draw.randint(1, 4)]) for _ in range(draw.randrange(70))) for _ in range(2))
        assert scorers.edits(a, b) == plain_script(a, b) and scorers.distance(a, b) == plain_distance(a, b) == scorers.distance(list(a), list(b))
    assert scorers.edits("", "") == (0, 0, 0, 0) and scorers.edits("", "ab") == (2, 2, 0, 0) and scorers.edits("ab", "") == (2, 0, 2, 0)
    assert scorers.edits("a", "é") == (1, 0, 0, 1) and scorers.distance([1, None, 2], [None, 2]) == 1


def test_page_length_scripts_need_little_memory():
    import tracemalloc

    draw = random.Random(3)
    a = [f"w{draw.randrange(3000)}" for _ in range(20_000)]
    b = [w if draw.random() < 0.9 else f"q{draw.random()}" for w in a if draw.random() < 0.95]
    tracemalloc.start()
    total, more, less, other = scorers.edits(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert total == more + less + other == scorers.distance(a, b) and more - less == len(b) - len(a)


def test_long_texts_are_scored_as_short_ones(spark, monkeypatch):
    rows = [("kitten", "sitting"), ("", "abc"), (None, "x"), ("x", None), ("é" * 1500, "é" * 1400 + "z")]
    df = spark.createDataFrame(rows, "a string, b string")
    want = [3, 3, None, None, 100]
    assert [r[0] for r in df.select(scorers.char_distance(F.col("a"), F.col("b"))).collect()] == want
    monkeypatch.setattr(scorers, "CELLS", 4)
    assert [r[0] for r in df.select(scorers.char_distance(F.col("a"), F.col("b"))).collect()] == want


@pytest.mark.parametrize("per_cell,per_author,seed", [(5, 2, "s"), (3, 1, "t")])
def test_capped_strata_equal_a_plain_draw(spark, per_cell, per_author, seed):
    draw = random.Random(5)
    names = [f"c{i}" for i in range(20)]
    rows = [(i, draw.choice(names), draw.choice([None, "unknown", *(f"a{k}" for k in range(25))])) for i in range(900)]
    cells = [["c0", "c1"], ["c1"], ["c2", "c0"], ["none", "c2"], *([n] for n in names[3:])]
    got = voting.capped_strata(spark.createDataFrame(rows, "id long, cell string, author string"), cells, "cell", "id", "author", per_cell, per_author, seed)
    assert [tuple(r) for r in got.collect()] == plain_draw(rows, cells, per_cell, per_author, seed)


@pytest.mark.parametrize("seed", ["s0", "s1", "s2", "s3"])
def test_capped_strata_behind_full_authors(spark, seed):
    """Nine cells fill an author each; the last holds 30 rows of each of these and one of a free author."""
    rows = [(i, f"c{i}", f"a{i}") for i in range(9)]
    rows += [(100 + i, "c9", f"a{i % 9}") for i in range(270)] + [(999, "c9", "free")]
    got = voting.capped_strata(spark.createDataFrame(rows, "id long, cell string, author string"), [[f"c{i}"] for i in range(10)], "cell", "id", "author", 1, 1, seed)
    assert [(r.cell, r.key) for r in got.collect()] == [*((f"c{i}", i) for i in range(9)), ("c9", 999)]


def test_labels_for_any_number_of_voters(spark):
    assert voting.letters(29)[24:] == ["Y", "Z", "AA", "AB", "AC"] and voting.letters(703)[-1] == "AAA" and len(set(voting.letters(2000))) == 2000
    voters = [f"v{i}" for i in range(30)]
    rows = voting.labelled(spark.createDataFrame([("p",), ("q",)], "page string"), voters, "x").collect()
    for page in "pq":
        assert sorted(r.voter for r in rows if r.page == page) == sorted(voters) and {r.label for r in rows if r.page == page} == set(voting.letters(30))


def test_volumes_of_file_names(spark):
    names = [("Rachanabali-11.pdf", ["11"]), ("a/b-7/Rachanabali-12.pdf", ["12"]), ("খণ্ড-২.epub", ["2"]), ("Set Part-3", ["3"]), ("দ্বিতীয় বই.pdf", ["2"]), (".hidden", []), ("plain.pdf", []), ("x 007", ["7"])]
    got = spark.createDataFrame(names, "name string, want array<string>").withColumn("v", keys.volume_tokens(F.col("name"))).collect()
    assert all(r.v == r.want for r in got), got
    edges = spark.createDataFrame([(1, 2, "page_image"), (1, 3, "page_image"), (1, 2, "metadata_exact")], "a long, b long, method string")
    facts = spark.createDataFrame([(1, "Rachanabali-11.pdf", None), (2, "Rachanabali-12.pdf", None), (3, "copy/Rachanabali-11.PDF", None)], "doc_id long, name string, title string")
    assert {(r.b, r.method): r.vetoed for r in dedupe.vetoed(edges, facts).collect()} == {(2, "page_image"): True, (3, "page_image"): False, (2, "metadata_exact"): False}


def test_isbn_runs_equal_two_passes(spark):
    """All runs of 13 are found before any of 10."""
    import re

    def plain(text):
        spans = [m.span() for m in re.finditer(r"(?<!\d)(?:\d[\s\-\u00ad]?){13}(?!\d)", text)]
        for m in re.finditer(r"(?<!\d)(?:\d[\s\-\u00ad]?){9}[\dXx](?!\d)", text):
            if not any(m.start() < e and s < m.end() for s, e in spans):
                spans.append(m.span())
        return [text[s:e] for s, e in sorted(spans)]

    assert keys.isbn_runs("12 978-0-3064-0615-7, 0-306-40615-2") == ["978-0-3064-0615-7", "0-306-40615-2"]  # one pattern takes "12 978-0-3064"
    assert keys.isbn_runs("ISBN 978 0 306 40615 7 x 080442957x") == ["978 0 306 40615 7 ", "080442957x"]
    draw = random.Random(2)
    said = ["".join(draw.choice("0123456789-- Xx,") for _ in range(90)) for _ in range(2000)]
    assert all(keys.isbn_runs(s) == plain(s) for s in said)
    got = spark.createDataFrame([(said[0],), (None,), ("",)], "t string").select(keys.isbn_candidates("t").alias("r")).collect()
    assert [r.r for r in got] == [plain(said[0]), None, []]


def test_cover_lines(spark):
    rows = [("p", "My", 0.9, 100, 0, 10, 90), ("p", "Title", 0.8, 90, 120, 20, 95), ("p", "Author", 0.7, 50, 300, 20, 60), ("p", "far", 0.6, 52, 900, 20, 60)]
    got = spatial.merged_lines(spark.createDataFrame(rows, "page string, text string, confidence double, height int, top int, left int, right int"), "page").orderBy("place").collect()
    assert [(r.text, r.confidence, r.height) for r in got] == [("My Title", 0.8, 100), ("far", 0.6, 52), ("Author", 0.7, 50)]


def test_file_names():
    fields = lambda p: filenames.parse_path(p)[:2]
    site = "data/incoming-scraped"
    assert fields(f"{site}/bengaliebook/books/বই এক -লেখক দুই (Book One by Writer Two).pdf") == (["বই এক", "Book One"], ["লেখক দুই", "Writer Two"])
    assert fields(f"{site}/amarbooks/books/Some Writer is waiting to be download!!! - Some Title - 0123456789ab.pdf") == (["Some Title"], ["Some Writer"])
    assert fields(f"{site}/amarbooks/books/Unknown Author - A Title is waiting to be download!!!.pdf") == (["A Title"], [])
    assert fields(f"{site}/banglabooks_in/books/Bangla eBooks pdf - 12.pdf") == ([], [])
    assert filenames.parse_path("x/বিবিধ/নাম [সংস্করণ-৫] (25).pdf")[3:6] == ("25", "5", None)
    assert filenames.parse_path("x/মাসুদ রানা সিরিজ/কিছু রচনা রহিম করিম.pdf")[:2] == (["কিছু"], ["রহিম করিম"])
    assert filenames.parse_path("x/y/৫০টি বইয়ের ডাউনলোড লিঙ্ক.pdf")[6]
    assert filenames.parse_title("শ্রেষ্ঠ কবিতা - শফিকুল ইসলাম")[:2] == (["শ্রেষ্ঠ কবিতা"], ["শফিকুল ইসলাম"])
    assert filenames.parse_title("One thing - other")[:2] == (["One thing - other"], [])


def test_pairs_scored_together_equal_pairs_scored_alone(spark):
    """Short pairs of a batch take their steps together; long, empty and null ones are scored alone; 4,000 different pairs at once."""
    import time

    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    rows = [(word(n, letters), word(n, letters)) for n, letters in ((6, "ab "), (31, "abcdefg  "), (66, "ab c"), (20, "aé漢\U0001f600 "), (5, " "), (90, "abc ")) for _ in range(150)]
    rows += [(None, "a"), ("a", None), (None, None), ("", ""), ("a" * 64, "a" * 64), ("x" * 65, "x" * 64)]
    pairs = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = pairs.select("a", "b", scorers.title_score("a", "b").alias("t"), scorers.match_score("a", "b").alias("m")).collect()
    for r in got:
        none = r.a is None or r.b is None
        assert (r.t, r.m) == ((None, None) if none else (scorers.title_similarity(r.a, r.b), scorers.best_of_sort_and_part(r.a, r.b)))
    names = [(word(40, "abcdefgh  ") + "x", word(40, "abcdefgh  ") + "y") for _ in range(4000)]
    start = time.process_time()
    scorers._many(names, scorers.np.zeros(len(names), bool))
    together, start = time.process_time() - start, time.process_time()
    for p in names[:400]:
        scorers.best_of_sort_and_part(*p)
    assert together < 5 * (time.process_time() - start)  # half of what they take alone, at most
