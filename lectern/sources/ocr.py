"""Readers of recognised text: word tables, cloud results, page XML, archives; each gives lines or pages as rows."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapsed, nfc, without_tags

POINT = "struct<x:double,y:double>"
SYMBOL = f"struct<text:string,boundingBox:struct<vertices:array<{POINT}>>,property:struct<detectedBreak:struct<type:string>>>"
WORD = f"struct<symbols:array<{SYMBOL}>,boundingBox:struct<vertices:array<{POINT}>>,property:struct<detectedBreak:struct<type:string>>>"
VISION = f"responses array<struct<fullTextAnnotation:struct<pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<{WORD}>>>>>>>>>>"
AZURE_BLOCKS = f"array<struct<lines:array<struct<text:string,boundingPolygon:array<{POINT}>,words:array<struct<text:string,confidence:double>>>>>>"
AZURE = f"readResult struct<blocks:{AZURE_BLOCKS}>, blocks {AZURE_BLOCKS}"
RECORD = "array<struct<text:string,bbox:array<double>,conf:double>>"
#: Breaks that end a line.
END_OF_LINE = ("EOL_SURE_SPACE", "LINE_BREAK", "HYPHEN")
LINE = ["text", "x0", "y0", "x1", "y1", "conf"]


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, paragraph, line, text, x0, y0, x1, y1, conf): lines of a tab-separated table of words. Only rows of level
    5 with text and whole numbers count; the confidence is the mean of those of 0 or more, 0 without any."""
    names = ["level", "page", "block", "paragraph", "line", "word", "left", "top", "width", "height", "conf", "text"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("c")).where(F.size("c") >= 12)
    at = lambda n: F.col("c")[names.index(n)]
    number = lambda n: at(n).try_cast("int").alias(n)
    words = rows.where((at("level").try_cast("int") == 5) & (F.trim(at("text")) != "")).select("file", *[number(n) for n in ("block", "paragraph", "line", "word", "left", "top", "width", "height")], at("conf").try_cast("double").alias("conf"), F.trim(at("text")).alias("text"))
    words = words.dropna(subset=["block", "paragraph", "line", "left", "top", "width", "height", "conf"]).where("width >= 0 and height >= 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "left", "text"))), lambda w: w["text"]), " ")
    return words.groupBy("file", "block", "paragraph", "line").agg(said.alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("conf"))


def _corners(vertices: Column) -> list[Column]:
    """x0, y0, x1, y1 of a polygon; a missing coordinate is 0; null without points."""
    side = lambda f, c: F.when(F.size(vertices) > 0, f(F.transform(vertices, lambda p: F.coalesce(p[c], F.lit(0.0)))))
    return [side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")]


def vision_lines(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, block, paragraph, line, text, x0, y0, x1, y1): lines of a cloud result of pages, blocks, paragraphs, words and
    symbols. A line ends with its paragraph or behind a word whose break, or whose last symbol's, ends one. A word without a
    box has that of its symbols; words without text and lines without a box go."""
    got = rows.select(key, F.from_json(raw, VISION)["responses"].alias("r")).select(key, F.posexplode(F.try_element_at("r", F.lit(1))["fullTextAnnotation"]["pages"]).alias("page", "p"))
    got = got.select(key, "page", F.posexplode("p.blocks").alias("block", "b")).select(key, "page", "block", F.posexplode("b.paragraphs").alias("paragraph", "g"))
    got = got.select(key, "page", "block", "paragraph", F.posexplode("g.words").alias("k", "w")).where("w.symbols is not null")
    ends = F.coalesce(F.col("w.property.detectedBreak.type"), F.try_element_at(F.filter(F.transform("w.symbols", lambda s: s["property"]["detectedBreak"]["type"]), lambda b: b.isNotNull()), F.lit(-1)))
    box = F.when(F.size("w.boundingBox.vertices") > 0, F.col("w.boundingBox.vertices")).otherwise(F.flatten(F.filter(F.transform("w.symbols", lambda s: s["boundingBox"]["vertices"]), lambda v: v.isNotNull())))
    place = [key, "page", "block", "paragraph"]
    words = got.select(*place, "k", F.array_join(F.transform("w.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("text"), F.coalesce(ends.isin(*END_OF_LINE), F.lit(False)).cast("int").alias("end"), *[c.alias(n) for c, n in zip(_corners(box), ("x0", "y0", "x1", "y1"))])
    before = Window.partitionBy(*place).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lines = words.withColumn("line", F.coalesce(F.sum("end").over(before), F.lit(0))).where("text <> ''")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda w: w["text"]), " ")
    out = lines.groupBy(*place, "line").agg(said.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("x0 is not null")
    return out.withColumn("text", collapsed(nfc(F.col("text"))))


def polygon_lines(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, block, line, text, x0, y0, x1, y1, conf): lines of a cloud result with polygons; conf is the mean of the words'."""
    parsed = rows.select(key, F.from_json(raw, AZURE).alias("r")).select(key, F.posexplode(F.coalesce("r.readResult.blocks", "r.blocks")).alias("block", "b"))
    each = parsed.select(key, "block", F.posexplode("b.lines").alias("line", "l")).where("l.text is not null and size(l.boundingPolygon) > 0")
    known = F.filter(F.transform("l.words", lambda w: w["confidence"]), lambda c: c.isNotNull())
    conf = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known))
    return each.select(key, "block", "line", collapsed(nfc(F.col("l.text"))).alias("text"), *[c.alias(n) for c, n in zip(_corners(F.col("l.boundingPolygon")), ("x0", "y0", "x1", "y1"))], conf.alias("conf"))


def record_lines(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, line, text, x0, y0, x1, y1, conf): lines of JSON records; rows without text or four numbers go, turned boxes are
    put right."""
    each = rows.select(key, F.posexplode(F.from_json(raw, RECORD)).alias("line", "l")).where("l.text is not null and size(l.bbox) = 4 and not exists(l.bbox, x -> x is null)")
    b = F.col("l.bbox")
    return each.select(key, "line", collapsed(nfc(F.col("l.text"))).alias("text"), F.least(b[0], b[2]).alias("x0"), F.least(b[1], b[3]).alias("y0"), F.greatest(b[0], b[2]).alias("x1"), F.greatest(b[1], b[3]).alias("y1"), F.col("l.conf").alias("conf"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def page_xml_lines(data: bytes) -> list[str]:
    """Reference lines of a page: those of each region's lines, else the region's own text, line by line."""

    def own(node):
        for part in node:
            if _local(part.tag) == "TextEquiv":
                for text in part:
                    if _local(text.tag) == "Unicode" and (text.text or "").strip():
                        return text.text.strip()
        return ""

    out: list[str] = []
    for region in ET.fromstring(data).iter():
        if _local(region.tag) == "TextRegion":
            lines = [t for part in region if _local(part.tag) == "TextLine" and (t := own(part))]
            out += lines or [x.strip() for x in own(region).splitlines() if x.strip()]
    return out


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of page XML files; files that are no XML have no lines."""

    def read(batches):
        for part in batches:
            rows = []
            for name, data in zip(part["path"], part["content"]):
                try:
                    rows += [(name, k, t) for k, t in enumerate(page_xml_lines(bytes(data)))]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "line", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, line long, text string")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of lines ``name TAB text``, in NFC, without blank texts."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("name"), F.trim(nfc(parts[1])).alias("text")).where("text <> ''")


def archive_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, width, height, text): pages of zipped extractions. A page's text is its blocks' by (chapter, order), one a
    line; ``pages.xml`` has the sizes. Files that are no such archives have no pages."""

    def pages(data):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            sizes = {int(n.attrib["index"]): (int(n.attrib["width"]), int(n.attrib["height"])) for n in ET.fromstring(archive.read("pages.xml")).findall("page")}
            blocks: dict[int, list] = {}
            for k, name in enumerate(sorted(n for n in archive.namelist() if n.startswith("chapters/") and n.endswith(".xml"))):
                for b in ET.fromstring(archive.read(name)).iter("block"):
                    if (at := b.attrib.get("page_index", "")).isdigit():
                        order = b.attrib.get("order", "0")
                        blocks.setdefault(int(at), []).append((k, int(order) if order.lstrip("-").isdigit() else 0, len(blocks.get(int(at), [])), (b.text or "").strip()))
        return [(p, w, h, "\n".join(t for *_, t in sorted(blocks.get(p, [])) if t)) for p, (w, h) in sorted(sizes.items())]

    def read(batches):
        for part in batches:
            rows = []
            for name, data in zip(part["path"], part["content"]):
                try:
                    rows += [(name, *p) for p in pages(bytes(data))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "width", "height", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, page long, width long, height long, text string")


def epub_texts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, text): the members of e-books that are web pages, by name, without tags; whole, or the first ``most`` characters."""

    def read(batches):
        for part in batches:
            rows = []
            for name, data in zip(part["path"], part["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
                        names = sorted(n for n in archive.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
                        text = "".join(re.sub(r"<[^>]+>", " ", archive.read(n).decode("utf-8", "replace")) for n in names)
                except zipfile.BadZipFile:
                    text = ""
                rows.append((name, text if most is None else text[:most]))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def body_text(html: Column) -> Column:
    """The text of a page's body, or of all of it without one."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    bare = F.regexp_replace(F.when(body != "", body).otherwise(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return without_tags(bare)
