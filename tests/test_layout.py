"""Passes over pages, and queries without SQL, against plain versions."""

import difflib
import random
import statistics

from pyspark.sql import functions as F

from lectern.operators import corpus, spatial
from lectern.plans import registry
from lectern.plans import evaluation, keys  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"


def plain_rows(boxes):
    out = {}
    for page in {b[0] for b in boxes}:
        mine = sorted(((b[3] + b[5]) / 2, b[2], b[1], b) for b in boxes if b[0] == page)
        tall, first, row = statistics.median(b[3][5] - b[3][3] for b in mine), None, -1
        for cy, _, key, _ in mine:
            if first is None or cy - first >= tall / 2:
                first, row = cy, row + 1
            out[page, key] = row
    return out


def boxes(draw, n, pages):
    out = []
    for i in range(n):
        x, y = draw.randrange(400), draw.randrange(60)
        out.append((draw.choice(pages), i, x, y, x + draw.randrange(1, 40), y + draw.randrange(1, 20)))
    return out


def test_rows_of_pages(spark):
    rows = boxes(random.Random(1), 600, ["p", "q", None, "r"])
    df = spark.createDataFrame([(*b, "x") for b in rows], "page string, id long, x0 int, y0 int, x1 int, y1 int, row string").repartition(5)
    assert {(r.page, r.id): r.row for r in spatial.rows_by_height(df, "page", "id").collect()} == plain_rows(rows)
    assert spatial.rows_by_height(df.where("false"), "page", "id").count() == 0
    assert spatial.rows_by_height(df.limit(1).select("page", "id", "x0", F.lit(None).cast("int").alias("y0"), "x1", "y1"), "page", "id").count() == 0


def plain_blocks(lines):
    out = []
    for page in sorted({x["page"] for x in lines}):
        blocks = []
        for x in sorted((x for x in lines if x["page"] == page), key=lambda x: (x["top"], x["left"], x["right"], x["height"], x["confidence"], x["text"])):
            b = blocks[-1] if blocks else None
            if b and min(x["height"], b["height"]) >= 0.75 * max(x["height"], b["height"]) and 0 <= x["top"] - b["top"] <= 1.8 * b["height"] and min(x["right"], b["right"]) > max(x["left"], b["left"]):
                blocks[-1] = b | {"left": min(x["left"], b["left"]), "right": max(x["right"], b["right"]), "height": max(x["height"], b["height"]), "confidence": min(x["confidence"], b["confidence"]), "text": f"{b['text']} {x['text']}"}
            else:
                blocks.append(dict(x))
        blocks.sort(key=lambda b: (-b["height"], -b["confidence"], b["top"], b["left"], b["right"], b["text"]))
        out += [(page, k, b["text"], b["height"], b["top"], b["left"], b["right"]) for k, b in enumerate(blocks)]
    return out


def test_cover_blocks(spark):
    draw = random.Random(2)
    lines = []
    for i in range(300):
        left = draw.randrange(200)
        lines.append({"page": draw.choice("abc"), "text": f"t{i}", "confidence": draw.random(), "height": float(draw.randrange(8, 14)), "top": float(draw.randrange(900)), "left": float(left), "right": float(left + draw.randrange(1, 150))})
    df = spark.createDataFrame(lines).repartition(4)
    got = sorted((r.page, r.place, r.text, r.height, r.top, r.left, r.right) for r in spatial.merged_lines(df, "page").collect())
    assert got == plain_blocks(lines) and len(got) < 300
    assert spatial.merged_lines(df.where("false"), "page").count() == 0


def test_texts_of_regions(spark):
    """A line belongs to the region that covers most of it, half at least; its rows are read from the top."""
    draw = random.Random(3)
    lines = boxes(draw, 300, ["p", "q"])
    regions = [(p, 100 * k + j, 130 * k, 40 * j, 130 * k + 120, 40 * j + 40) for p in "pq" for k in range(3) for j in range(2)]
    cols = "page string, id long, x0 int, y0 int, x1 int, y1 int"
    common = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    placed = {}
    for a in lines:
        best = max(((common(a, r) / ((a[4] - a[2]) * (a[5] - a[3])), -r[1]) for r in regions if r[0] == a[0]), default=(0, 0))
        if best[0] >= 0.5:
            placed.setdefault((a[0], -best[1]), []).append(a)
    want = {}
    for (page, region), own in placed.items():
        row = plain_rows(own)
        texts = [" ".join(f"w{b[1]}" for b in sorted((b for b in own if row[page, b[1]] == k), key=lambda b: (b[2], b[1]))) for k in sorted(set(row.values()))]
        want[page, region] = "\n".join(texts)
    df = spark.createDataFrame(lines, cols).withColumn("text", F.concat(F.lit("w"), F.col("id").cast("string")))
    got = corpus.aligned_pages(df, spark.createDataFrame(regions, cols), "page", "id", "text").collect()
    assert {(r.page, r.region): r.text for r in got} == want and len(want) > 8


def test_difflib_ratios_and_engine_proxies(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    got = {r.p_partkey: r.score for r in registry.QUERIES["difflib_ratios"](spark, SF).collect()}
    assert got == {r.p_partkey: ratio(r.p_name, r.p_type.lower()) for r in part}
    arms = {}
    for r in part:
        said, heard = f"{r.p_name} {r.p_brand}", f"{r.p_type.lower()} {r.p_name.split(' ')[1]}"
        arms.setdefault(r.p_brand, []).append((ratio(said, heard), sum("\u0980" <= c <= "\u09ff" or c in "\u0964\u0965" or c in "0123456789" for c in said) / sum(not c.isspace() for c in said)))
    got = {r.arm: (r.similarity, r.block_ratio) for r in registry.QUERIES["engine_proxies"](spark, SF).collect()}
    assert got.keys() == arms.keys() and all(abs(got[a][0] - statistics.fmean(x for x, _ in v)) < 1e-9 and abs(got[a][1] - statistics.fmean(x for _, x in v)) < 1e-9 for a, v in arms.items())


def test_boxes_of_fifty_pages_equal_brute_force(spark, monkeypatch):
    """Pages do not grow in number with the table; the smallest box is found though few of a page are looked at."""
    from lectern.plans.more import boxes as made

    orders = spark.createDataFrame([(i * 37, i * 7919 % 100000, "FOP"[i * i % 3]) for i in range(900)] + [(10**6 + k, 0, "F") for k in range(9)], "o_orderkey long, o_custkey long, o_orderstatus string")
    words, regions = made(orders)
    assert {r.page for r in words.select("page").distinct().collect()} <= set(range(50))
    w, r = ([(x.page % 3, x.id, x.x0, x.y0, x.x1, x.y1) for x in df.collect()] for df in (words, regions.where("s = 'F'")))
    r += [(p, 10**7 + k, *corners) for k, (p, _, *corners) in enumerate(r[:40])] + [(5, 10**8, 0, 0, 9, 9)]
    w += [(9, 10**9, 0, 0, 5, 5), (9, 10**9 + 1, 0, 1, 5, 5), (5, 10**9 + 2, 500, 500, 600, 600)]
    common = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3])) if a[0] == b[0] else 0
    size = lambda a: (a[4] - a[2]) * (a[5] - a[3])
    kind = "page long, id long, x0 long, y0 long, x1 long, y1 long"
    dw, dr = spark.createDataFrame(w, kind), spark.createDataFrame(r, kind)
    monkeypatch.setattr(spatial, "SLICES", (2, 9, 30))
    monkeypatch.setattr(spatial.first_met, "__defaults__", (None, (2, 9, 30)))
    best = {a[1]: max(((common(a, b) / size(a), -b[1]) for b in r if common(a, b) / size(a) >= 0.5), default=None) for a in w}
    assert {x.line: (x.share, -x.region) for x in spatial.assign(dw, dr, "page", "id").collect()} == {k: v for k, v in best.items() if v}
    inside = {a[1]: min((b[1] for b in r if common(a, b) == size(a)), default=None) for a in w}
    assert {x.line: x.region for x in spatial.containing(dw, dr, "page", "id").collect()} == {k: v for k, v in inside.items() if v is not None}
    assert sorted(x.id for x in spatial.omitted(dw, dr, "page", "id", 0.05).collect()) == sorted(a[1] for a in w if not any((c := common(a, b)) / (size(a) + size(b) - c) >= 0.05 for b in r))
    want = {}
    for a in w:
        met = [b[1] for b in r if common(a, b)]
        near = [(abs(a[3] + a[5] - b[3] - b[5]), b[1]) for b in r if b[0] == a[0]]
        want[a[1]] = (min(met), True) if met else (min(near)[1], False) if near else ({10**9: 0, 10**9 + 1: 1}[a[1]], False)
    assert {x.word: (x.line, x.hit) for x in spatial.nearest_lines(dw, dr, "page", "id").collect()} == want
