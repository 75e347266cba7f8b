"""Reference fixtures of all forms, and hooks that SQL calls."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluation, review
from lectern.sources import fixtures


def page(*lines):
    body = "".join(f"<TextLine><TextEquiv><Unicode>{t}</Unicode></TextEquiv></TextLine>" for t in lines)
    return f'<PcGts xmlns="u"><Page><TextRegion>{body}</TextRegion></Page></PcGts>'


def test_a_folder_with_all_forms(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "p 1.xml").write_text(page("one", "two"))
    (tmp_path / "q.XML").write_text(page("three"))
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps({"id": " a 1", "split": "Dev ", "text": "é x ", "extra": {"k": [1, 2]}}), "", json.dumps({"ref_id": "b", "id": "other", "split": "test", "reference": "y", "license": "cc", "overlap_note": "n"})]))
    (tmp_path / "list.json").write_text(json.dumps([{"id": "c", "split": "s", "text": "z", "license": ""}]))
    (tmp_path / "object.json").write_text(json.dumps({"license": "mit", "overlap_note": "all", "records": [{"id": "d", "split": "s", "text": "w"}, {"id": "e", "split": "s", "text": "v", "overlap_note": "", "license": "own"}]}))
    (tmp_path / "notes.txt").write_text("no fixture")
    rows = {r.ref_id: r for r in fixtures.reference_fixtures(spark, str(tmp_path), "set", "v1").withColumn("k", F.try_variant_get("payload", "$.extra.k[1]", "int")).collect()}
    got = {k: (r.split, r.text, json.loads(r.source)["overlap_note"], r.license) for k, r in rows.items()}
    assert got == {"set:p 1:L0000": ("test", "one", "", "unknown"), "set:p 1:L0001": ("test", "two", "", "unknown"), "set:q:L0000": ("test", "three", "", "unknown"),
                   " a 1": ("Dev ", "é x ", "", "unknown"), "b": ("test", "y", "n", "cc"), "c": ("s", "z", "", "unknown"), "d": ("s", "w", "all", "mit"), "e": ("s", "v", "", "own")}
    assert rows["d"].source == '{"dataset":"set","overlap_note":"all","version":"v1"}' and rows[" a 1"].k == 2 and rows["b"].k is None
    assert fixtures.reference_fixtures(spark, str(tmp_path / "r.jsonl"), "set", "v1").count() == 2


@pytest.mark.parametrize("name,body,problem", [("a.jsonl", '{"id": "", "split": "s", "text": "t"}', "without id"), ("a.jsonl", '{"id": "x", "text": "t"}', "without split"), ("a.json", '[{"id": "x", "split": "s"}]', "without text"),
                                               ("a.json", '{"rows": []}', "neither a list"), ("a.xml", "<broken", "no XML"), ("a.jsonl", "{broken", "MALFORMED")])
def test_what_would_lose_a_reference_is_an_error(spark, tmp_path, name, body, problem):
    (tmp_path / name).write_text(body)
    with pytest.raises(Exception, match=problem):
        fixtures.reference_fixtures(spark, str(tmp_path), "set", "v1").collect()


def test_disagreements_as_a_table_function(spark):
    evaluation.register(spark)
    rows = [(1, "a b c d", "a x c d e"), (2, "same", "same"), (3, None, "new words"), (4, "gone", None)]
    spark.createDataFrame(rows, "page int, base string, other string").createOrReplaceTempView("pages_read")
    got = spark.sql("SELECT page, d.k, d.start, d.end, d.before, d.after FROM pages_read, LATERAL disagreements(base, other) d").collect()
    want = [(p, k, e["start"], e["end"], e["before"], e["after"]) for p, a, b in rows for k, e in enumerate(evaluation.disagreements(a or "", b or ""))]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 4


def test_gates_decide_one_after_the_other(spark):
    rows = [(1, "a", "a", 50.0, True), (2, "a", "b", 50.0, True), (3, "a", "bcde", 50.0, True), (4, "a", "b", 90.0, True), (5, "a", "b", 50.0, False), (6, "a", "b", None, True), (7, "a", "b", 50.0, None), (8, None, "b", 50.0, True)]
    df = spark.createDataFrame(rows, "id int, before string, after string, confidence double, agreed boolean")
    gates = [review.unchanged("before", "after"), review.edit_size("before", "after", 2), review.confidence_below("confidence", 70.0), review.agreement("agreed")]
    got = {r.id: (r.decision, r.gate) for r in review.decided(df, gates).collect()}
    assert got == {1: ("reject", "unchanged"), 2: ("accept", None), 3: ("reject", "edit_size"), 4: ("reject", "confidence"), 5: ("reject", "agreement"), 6: ("abstain", "confidence"), 7: ("abstain", "agreement"), 8: ("abstain", "unchanged")}
    chance = review.probability_from(F.col("confidence") / 100, 0.6)
    assert {r.id: r.decision for r in review.decided(df, [chance]).collect()} == {1: "abstain", 2: "abstain", 3: "abstain", 4: "accept", 5: "abstain", 6: "abstain", 7: "abstain", 8: "abstain"}
