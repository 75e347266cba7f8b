"""Joins of boxes (x0, y0, x1, y1) on the same page."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.storage import cut

#: Places on a page, in the order of keys, at which a slice of its boxes ends.
SLICES = (64, 512, 4096, 32768)


def _box(rows: DataFrame, page: str, key: str, side: str) -> DataFrame:
    return rows.select(F.col(page).alias("page"), F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("x0", "y0", "x1", "y1")])


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def overlaps(left: DataFrame, right: DataFrame, page: str, key: str, size: int = 256) -> DataFrame:
    """(page, a, b, the boxes' corners, common): pairs of boxes with a common area, ``common``.

    Boxes are dealt to the cells of a grid that they touch, and a pair is taken only in the cell that holds the upper left
    corner of what they share. So each pair comes once, and a page with many boxes is dealt over many tasks. Boxes without
    an area and boxes with nulls have no pairs.
    """
    sides = []
    for rows, s in ((left, "a"), (right, "b")):
        b = _box(rows, page, key, s).where(f"x0_{s} < x1_{s} and y0_{s} < y1_{s}")
        sides.append(b.withColumn("cx", _cells(F.col(f"x0_{s}"), F.col(f"x1_{s}"), size)).withColumn("cy", _cells(F.col(f"y0_{s}"), F.col(f"y1_{s}"), size)))
    x, y = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    width, height = F.least("x1_a", "x1_b") - x, F.least("y1_a", "y1_b") - y
    met = sides[0].join(sides[1], ["page", "cx", "cy"]).where((width > 0) & (height > 0) & (F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy")))
    return met.withColumn("common", width * height).drop("cx", "cy")


def area(side: str) -> Column:
    return (F.col(f"x1_{side}") - F.col(f"x0_{side}")) * (F.col(f"y1_{side}") - F.col(f"y0_{side}"))


def iou() -> Column:
    """Common area by the area of both boxes together, for rows of ``overlaps``."""
    return F.col("common").cast("double") / (area("a") + area("b") - F.col("common"))


def _distinct(rows: DataFrame, page: str, key: str) -> DataFrame:
    """Boxes of the same page and corners by the smallest key alone, with their place ``at`` on the page in the order of keys."""
    at = F.row_number().over(Window.partitionBy(page).orderBy(key))
    return rows.where(F.col(page).isNotNull()).groupBy(page, "x0", "y0", "x1", "y1").agg(F.min(key).alias(key)).withColumn("at", at)


def first_met(left: DataFrame, right: DataFrame, page: str, key: str, met: Column | None = None, slices: tuple[int, ...] = SLICES) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the smallest right box with which each left box has a common area and ``met``, a condition on rows of
    ``overlaps``, holds; and the left boxes that have none. Both are cut.

    The right boxes of a page come in slices by rising key, each longer than the one before. A box that has found one leaves,
    as all that follow are larger; so a box of which one in n is met looks at about n of a page's boxes and not at all.
    """
    rest, found = left, []
    right = cut(_distinct(right, page, key))
    longest = right.agg(F.max("at")).first()[0] or 0
    ends = [*(n for n in slices if n < longest), longest]
    for low, high in zip((0, *ends), ends):
        pairs = overlaps(rest, right.where(F.col("at").between(low + 1, high)), page, key)
        found.append(cut((pairs if met is None else pairs.where(met)).groupBy("a").agg(F.min("b").alias("b"))))
        rest = cut(rest.join(found[-1], F.col(key).eqNullSafe(F.col("a")), "left_anti"))
    return reduce(DataFrame.union, found), rest


INSIDE = "x0_b <= x0_a and y0_b <= y0_a and x1_a <= x1_b and y1_a <= y1_b"


def assign(lines: DataFrame, regions: DataFrame, page: str, key: str, least: float = 0.5) -> DataFrame:
    """(line, region, share): the region that covers most of each line, at least ``least`` of it; ties to the smaller region.

    Nothing covers more of a line than a region that holds it, so only lines that none holds are measured against all."""
    whole, rest = first_met(lines, regions, page, key, F.expr(INSIDE))
    share = F.col("common").cast("double") / area("a")
    met = overlaps(rest, _distinct(regions, page, key), page, key).select("a", "b", share.alias("share")).where(F.col("share") >= least)
    best = met.groupBy("a").agg(F.max(F.struct("share", (-F.col("b")).alias("neg"))).alias("m"))
    parts = best.select(F.col("a").alias("line"), (-F.col("m.neg")).alias("region"), F.col("m.share").alias("share"))
    return whole.select(F.col("a").alias("line"), F.col("b").alias("region"), F.lit(1.0).alias("share")).where(F.lit(least <= 1)).union(parts)


def containing(lines: DataFrame, regions: DataFrame, page: str, key: str) -> DataFrame:
    """(line, region): the smallest region that holds the whole line."""
    return first_met(lines, regions, page, key, F.expr(INSIDE))[0].toDF("line", "region")


def omitted(regions: DataFrame, found: DataFrame, page: str, key: str, least: float = 0.3) -> DataFrame:
    """The regions that meet no found box of the page with an IoU of ``least`` or more."""
    return first_met(regions, found, page, key, iou() >= least)[1]


def _in_turn(rows: DataFrame, page: str, order: list[str], start: Callable[[], Callable], schema: T.StructType) -> DataFrame:
    """A pass over each page's rows in ``order``, as batches stream by: ``start()`` gives a step for a page, which takes a row and
    gives the rows that are done with, and takes None at the page's end. Only what a step holds is in memory."""
    names = schema.names

    def run(batches):
        now, step, out = None, None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in batch.schema.names]
            at = batch.schema.names.index(page)
            for row in zip(*columns):
                if step is None or row[at] != now:
                    out += step(None) if step else []
                    now, step = row[at], start()
                out += step(dict(zip(batch.schema.names, row)))
            yield _batch(out)
            out = []
        if step:
            yield _batch(step(None))

    kinds = to_arrow_schema(schema)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds.field(n).type) for n in names], names=names)

    return rows.repartition(page).sortWithinPartitions(page, *order).mapInArrow(run, schema)


def rows_by_height(boxes: DataFrame, page: str, key: str) -> DataFrame:
    """(page, key, row): boxes of a page from top to bottom, in rows numbered from 0. A box starts a new row if its middle
    lies half the page's median height or more below the middle of the box that started the row.

    A page's boxes pass by one after the other, so a page may hold any number; ties go from left to right, then by key. Boxes
    of a null page are a page, boxes without a middle are left out.
    """
    middle = ((F.col("y0") + F.col("y1")) / 2).cast("double")
    tall = boxes.groupBy(F.col(page).alias("_page")).agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("_tall"))
    named = boxes.select(page, key, middle.alias("_cy"), F.col("x0").alias("_x0")).where("_cy is not null")
    named = named.join(tall, F.col(page).eqNullSafe(F.col("_page"))).drop("_page")

    def start():
        state = {"cy": None, "row": -1}

        def step(box):
            if box is None:
                return []
            if state["cy"] is None or box["_cy"] - state["cy"] >= box["_tall"] / 2:
                state["cy"], state["row"] = box["_cy"], state["row"] + 1
            return [{page: box[page], key: box[key], "row": state["row"]}]

        return step

    kind = T.StructType([boxes.schema[page], boxes.schema[key], T.StructField("row", T.IntegerType())])
    return _in_turn(named, page, ["_cy", "_x0", key], start, kind)


def nearest_lines(words: DataFrame, lines: DataFrame, page: str, key: str) -> DataFrame:
    """(word, line, hit): the smallest line that each word's box meets; for the others the line with the nearest vertical
    centre, ties to the smaller. On pages without lines words get numbers of their own, from the top, from 0.

    Lines and words are put in one order of centres, so a word looks at the line before and behind it alone.
    """
    met, others = first_met(words, lines, page, key)
    hits = met.select(F.col("a").alias("word"), F.col("b").alias("line"), F.lit(True).alias("hit"))
    centre = (F.col("y0") + F.col("y1")) / 2
    rest = others.select(F.col(page).alias("page"), centre.alias("c"), F.col(key).alias("word"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("line"), ((F.col("x0") + F.col("x1")) / 2).alias("x"))
    own = lines.select(F.col(page).alias("page"), centre.alias("c"), F.col(key).alias("id")).groupBy("page", "c").agg(F.min("id").cast("long").alias("line"))
    own = own.select("page", "c", F.lit(None).cast("long").alias("word"), F.lit(0).alias("kind"), "line", F.lit(None).cast("double").alias("x"))
    order, back = Window.partitionBy("page").orderBy("c", "kind", "x", "word"), Window.partitionBy("page").orderBy(F.desc("c"), F.desc("kind"), F.desc("x"), F.desc("word"))
    side = F.when(F.col("line").isNotNull(), F.struct("c", "line"))
    # what follows is read backwards: a frame without an end is computed anew for each row
    before, after = (F.last(side, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (order, back))
    placed = own.union(rest).withColumn("up", before).withColumn("down", after).withColumn("n", F.row_number().over(order) - 1).where("word is not null")
    up, down = F.col("c") - F.col("up.c"), F.col("down.c") - F.col("c")
    nearest = F.when(F.col("down").isNull() | (up < down) | ((up == down) & (F.col("up.line") < F.col("down.line"))), F.col("up.line")).otherwise(F.col("down.line"))
    return hits.union(placed.select("word", F.coalesce(nearest, F.col("n").cast("long")).alias("line"), F.lit(False).alias("hit")))


def merged_lines(regions: DataFrame, page: str) -> DataFrame:
    """(page, place, text, confidence, height, top, left, right): the lines of each page joined into blocks, tallest first.

    From the top, a line joins the block before it if their heights differ by a quarter at most, it starts within 1.8 of
    the block's height below the block's top, and they overlap from left to right. A block has all texts, the least
    confidence, the largest height, and the block's first top. A page's lines pass by one after the other; one block is held.
    """
    numbers = ["top", "left", "right", "height", "confidence"]
    lines = regions.select(page, *[F.col(c).cast("double").alias(c) for c in numbers], "text")

    def start():
        held: list[dict] = []

        def step(x):
            last = held[-1] if held else None
            if x is None:
                return held
            if last and None not in (*(x[n] for n in numbers), *(last[n] for n in numbers)):
                gap = x["top"] - last["top"]
                alike = min(x["height"], last["height"]) >= 0.75 * max(x["height"], last["height"])
                if alike and 0 <= gap <= 1.8 * max(last["height"], 1.0) and min(x["right"], last["right"]) > max(x["left"], last["left"]):
                    last |= {"left": min(x["left"], last["left"]), "right": max(x["right"], last["right"]), "height": max(x["height"], last["height"]), "confidence": min(x["confidence"], last["confidence"]), "text": " ".join(t for t in (last["text"], x["text"]) if t is not None)}
                    return []
            done = held[:]
            held[:] = [dict(x)]
            return done

        return step

    blocks = _in_turn(lines, page, [*numbers, "text"], start, lines.schema)
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("height"), F.desc("confidence"), "top", "left", "right", "text")) - 1
    return blocks.select(page, place.alias("place"), "text", "confidence", "height", "top", "left", "right")
