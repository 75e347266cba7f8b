"""Readers, files and sinks on small files and tables."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, lines, ocr, records, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/x.pdf", b"one"), ("y.PDF", b"one"), ("z.txt", b"two"), ("list.txt", b"# c\n/p/1\n\n/p/1\n/p/2\n")):
        (tmp_path / name).write_bytes(body)
    found = {r.path.rsplit("/", 1)[-1]: (r.size, r.supported) for r in files.scan(spark, str(tmp_path)).collect()}
    assert found == {"x.pdf": (3, True), "y.PDF": (3, True), "z.txt": (3, False), "list.txt": (20, False)}
    assert sorted(r.path for r in files.path_list(spark, str(tmp_path / "list.txt")).collect()) == ["/p/1", "/p/2"]
    hashed = files.contents(spark, str(tmp_path), "*.[pP][dD][fF]")
    known = spark.createDataFrame([], "sha256 string, size long")
    documents, locations = files.ingest(known, hashed)
    assert [tuple(r) for r in documents.collect()] == [(hashlib.sha256(b"one").hexdigest(), 3)] and locations.count() == 2
    assert files.ingest(documents, hashed)[0].count() == 1
    cache = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), "v1", 7)], "sha256 string, version string, pages int")
    assert [f.count() for f in files.cached(hashed, cache, "v1")] == [2, 0] and [f.count() for f in files.cached(hashed, cache, "v2")] == [0, 2]


def test_bundle_refuses_gold(spark):
    rows = spark.createDataFrame([("a.json", "x", True), ("gold.json", "y", False)], "name string, body string, ok boolean")
    assert [r.sha256 for r in files.bundle(rows, "name", "body", "ok", ["gold"]).collect()] == [hashlib.sha256(b"x").hexdigest()]
    with pytest.raises(Exception, match="gold in a release"):
        files.bundle(rows.withColumn("ok", F.lit(True)), "name", "body", "ok", ["gold"]).collect()


def test_word_table(spark, tmp_path):
    rows = ["level\tpage\tblock\tparagraph\tline\tword\tleft\ttop\twidth\theight\tconf\ttext", "5\t1\t1\t1\t1\t2\t50\t22\t35\t18\t60\tworld", "5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t90\thello", "5\t1\t1\t1\t2\t1\t1\t50\t9\t9\t-1\tx", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\tbad"]
    (tmp_path / "t.tsv").write_text("\n".join(rows))
    got = sorted((r.line, r.text, r.x0, r.y0, r.x1, r.y1, r.conf) for r in ocr.word_table(spark, str(tmp_path / "t.tsv")).collect())
    assert got == [(1, "hello world", 10, 20, 85, 40, 75.0), (2, "x", 1, 50, 10, 59, 0.0)]


def test_page_xml_and_ground_truth(spark, tmp_path):
    line = "<TextLine><TextEquiv><Unicode> {} </Unicode></TextEquiv></TextLine>"
    (tmp_path / "p.xml").write_text(f'<PcGts xmlns="u"><Page><TextRegion>{line.format("a")}{line.format("b")}<TextEquiv><Unicode>all</Unicode></TextEquiv></TextRegion><TextRegion><TextEquiv><Unicode>c\n \nd</Unicode></TextEquiv></TextRegion></Page></PcGts>')
    (tmp_path / "q.xml").write_text("<broken")
    assert [r.text for r in ocr.page_xml(spark, str(tmp_path / "*.xml")).orderBy("line").collect()] == ["a", "b", "c", "d"]
    (tmp_path / "g.txt").write_text("n1\té x\nn2\t \nno tab\n")
    assert [tuple(r) for r in ocr.ground_truth(spark, str(tmp_path / "g.txt")).collect()] == [("n1", "é x")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.pcex", "w") as z:
        z.writestr("pages.xml", '<pages><page index="1" width="10" height="20"/><page index="2" width="11" height="21"/></pages>')
        z.writestr("chapters/2.xml", '<c><paragraph><block page_index="1" order="0">last</block></paragraph></c>')
        z.writestr("chapters/1.xml", '<c><paragraph><block page_index="1" order="2">two</block><block page_index="1" order="1">one</block><block page_index="x">no</block></paragraph></c>')
    (tmp_path / "b.pcex").write_bytes(b"no zip")
    assert [tuple(r)[1:] for r in ocr.archive_pages(spark, str(tmp_path / "*.pcex")).orderBy("page").collect()] == [(1, 10, 20, "one\ntwo\nlast"), (2, 11, 21, "")]
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("b.html", "<p>two</p>")
        z.writestr("a.xhtml", "<p>one</p>")
        z.writestr("c.css", "no")
    assert [r.text for r in ocr.epub_texts(spark, str(tmp_path / "e.epub")).collect()] == [" one  two "]


def test_records(spark, tmp_path):
    lines = [{"productType": "book", "name": "N", "specification": json.dumps({"Title": " ", "Author": "A", "ISBN": "1", "Number of Pages": "12 p"}), "url": "u"}, {"productType": "pen", "name": "P"}, {"productType": "book", "name": "M", "specification": json.dumps({"Title": "T"})}]
    (tmp_path / "d.jsonl").write_text("\n".join([json.dumps(lines[0]), "{broken", json.dumps(lines[1]), "", json.dumps(lines[2])]))
    rows = records.retail(spark, str(tmp_path / "d.jsonl")).orderBy("line").collect()
    assert [(r.line, r.title, r.author, r.pages) for r in rows] == [(1, "N", "A", 12), (5, "T", None, None)]
    assert [r.line for r in records.retail(spark, str(tmp_path / "d.jsonl"), after=1).collect()] == [5]
    old = spark.createDataFrame([("T ", ["A", "B"], "978-0-306-40615-7"), ("U", [], "12X"), (" ", ["C"], None)], "name string, authors array<string>, isbn string")
    assert sorted(map(tuple, records.legacy_books(old).collect())) == [("T", "A", "9780306406157"), ("U", None, None)]
    (tmp_path / "t.txt").write_text('/type/work\t/w/1\t3\t2020\t{"title": "W"}\n/type/author\t/a/1\t3\t2020\t{"title": "X"}\n{"key": "/b/2", "title": "Y"}\n{"key": "/b/3"}\n')
    assert sorted((r.key, r.title) for r in records.dump_records(records.tab_dump(spark, str(tmp_path / "t.txt"))).collect()) == [("/b/2", "Y"), ("/w/1", "W")]
    (tmp_path / "c.csv").write_text("title,year\na,1\n ,2\n")
    assert tuple(records.coverage_csv(spark, str(tmp_path / "c.csv"), ["title", "year", "authors"]).first()) == (2, 1, 2, None)
    (tmp_path / "h.jsonl").write_text('{"id": "1", "text": "a"}\n{"id": "2", "text": "b"}\n{"id": "1", "text": "c"}\n')
    assert sorted((r.id, r.text) for r in records.hypotheses(spark, str(tmp_path / "h.jsonl")).collect()) == [("1", "c"), ("2", "b")]


def test_lines_of_split_files(spark, tmp_path):
    """Many parts of two files give the numbers of one reading from the start."""
    conf = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    whole = {}
    for name, n, end in (("b.txt", 4000, "\n"), ("a.txt", 900, "\r\n")):
        whole[name] = [f"{name} {i} " + "é" * (i % 90) if i % 17 else "" for i in range(n)]
        (tmp_path / name).write_bytes((end.join(whole[name]) + (end if n == 900 else "")).encode())
    before = [spark.conf.get(c) for c in conf]
    try:
        for c, v in zip(conf, ("8kb", "1kb")):
            spark.conf.set(c, v)
        rows = lines.numbered(spark, str(tmp_path / "*.txt"))
        assert rows.rdd.getNumPartitions() > 4
        got = {}
        for r in rows.collect():
            got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.line] = r.value
        assert got == {k: dict(enumerate(v, 1)) for k, v in whole.items()}
        for k in range(3):  # the largest file first by size, the last by name
            said = [json.dumps({"id": str(i % 40), "text": f"{k}-{i}", "seconds": 1.0}) for i in range((3 - k) * 700)]
            (tmp_path / f"h{k}.jsonl").write_text("\n".join([*said, "{broken", json.dumps({"text": "no id"})]))
        assert {r.id: r.text for r in records.hypotheses(spark, str(tmp_path / "h*.jsonl")).collect()} == {str(i): f"2-{(680 if i < 20 else 640) + i}" for i in range(40)}
    finally:
        for c, v in zip(conf, before):
            spark.conf.set(c, v)


def test_dump_is_staged_in_batches_and_gone_on_with(spark, tmp_path):
    record = lambda i, **more: json.dumps({"productType": "book", "id": f"b{i}", "specification": json.dumps({"Title": f" T{i} "})} | more)
    said = [record(0), "", "{broken", record(1), record(2, productType="pen"), record(3, specification=json.dumps({"Title": " "})), record(0), record(4, id=None), record(5, id=""), record(6), record(1), record(7, specification="no json")]
    path, folder = str(tmp_path / "dump.jsonl"), str(tmp_path / "staged")
    (tmp_path / "dump.jsonl").write_text("\n".join(said) + "\n")
    assert lines.stage(spark, path, folder, 3, 1) == {"cursor": 3, "staged": 1, "skipped": 2, "ignored": 0}
    broken = tmp_path / "staged" / "batch-000000000000003"  # a run that died while it wrote
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert lines.stage(spark, path, folder, 3, 1)["cursor"] == 6
    assert lines.stage(spark, path, folder, 3) == lines.stage(spark, path, folder, 3) == {"cursor": 12, "staged": 5, "skipped": 5, "ignored": 2}
    rows = lines.staged(spark, folder).where("state = 'staged'").orderBy("line").collect()
    assert [(r.line, r.external_id, r.title) for r in rows] == [(1, "b0", "T0"), (4, "b1", "T1"), (8, "line:8", "T4"), (9, "line:9", "T5"), (10, "b6", "T6")]
    once = str(tmp_path / "once")
    assert lines.stage(spark, path, once) == lines.progress(lines.staged(spark, folder)) and lines.progress(lines.staged(spark, str(tmp_path / "nothing")))["cursor"] == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_once(rows, str(tmp_path / "once"))
    sinks.write_once(rows.orderBy(F.desc("k")), str(tmp_path / "once"))
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(rows.limit(1), str(tmp_path / "once"))
    sinks.export_lines(rows, str(tmp_path / "lines"), ["k"], "k > 1")
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "lines")).select("k", "v").collect()] == [(2, "b")]
    sinks.report(rows.agg(F.count("*").alias("n")), rows.select(F.col("v").alias("path")), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/removals")).count() == 2
    assert sinks.markdown(spark.createDataFrame([("b", 1.0), ("a", None)], "n string, x double"), ["n", "x"], ["n"]) == "| n | x |\n|-|-|\n| a | n/a |\n| b | 1.0000 |\n"
    with pytest.raises(ValueError, match="more than 1"):
        sinks.markdown(rows, ["k"], ["k"], most=1)
