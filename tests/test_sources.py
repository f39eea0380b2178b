"""Files, archives and JSON records made by hand."""

import datetime
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caselens.operators import evidence
from caselens.scratch import written
from caselens.sources import files, records


def test_notes_of_any_encoding(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("質問".encode("cp932"))
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfplain")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfd\x81")
    (tmp_path / "d.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.txt").write_text("no")
    rows = files.read_notes(spark, str(tmp_path)).collect()
    assert [r["text"] for r in rows][:2] == ["plain", "質問"] and len(rows) == 3 and "\ufffd" in rows[2]["text"]


def test_paths_stay_under_the_root(tmp_path):
    assert files.inside("a/b.json", str(tmp_path)) == str(tmp_path.resolve() / "a" / "b.json")
    (tmp_path / "link").symlink_to("/")
    for path in ("../x", "/etc/passwd", "a/../../x", "link/etc"):
        with pytest.raises(ValueError):
            files.inside(path, str(tmp_path))


def test_archives_reject_what_is_not_safe(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_ENTRY", 1000)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docs/a.txt", "fine")
        z.writestr("../b.txt", "out")
        z.writestr("/c.txt", "out")
        z.writestr("big.txt", "x" * 2000)
    rows = {r[1]: r[-1] for r in files.archive_entries("z.zip", data.getvalue())}
    assert rows == {"docs/a.txt": None, "../b.txt": "unsafe path", "/c.txt": "unsafe path", "big.txt": "too large"}
    assert [r[-1] for r in files.archive_entries("z.zip", b"no archive")] == ["corrupt"]
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    found = spark.read.format("binaryFile").load(str(tmp_path))
    row = files.archive_counters(files.read_archives(found)).first()
    assert (row["entries"], row["read"] + row["rejected"]) == (4, 4) and "unsafe path" in row["reasons"]


def test_office_files_have_limits(monkeypatch):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<s><t>Hello</t><t>there</t></s>")
    assert files.office_text("a.pptx", data.getvalue()) == [(None, "Hello there")]
    monkeypatch.setattr(files, "MAX_ENTRY", 10)
    assert files.office_text("a.pptx", data.getvalue()) == []


def test_case_folders_are_found_by_name(spark, tmp_path):
    for name in ("20240102(Acme_12)open_20240203", "2023(Old 777)done", "other"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "sub" / "n.txt").write_text("x")
    listing = files.inventory(spark, str(tmp_path))
    found = files.scan_case_folders(listing)
    assert {(r["company"], r["support_number"], r["status"], r["created_on"]) for r in found.collect()} == {("Acme", "12", "open", "20240102"), ("Old", "777", "done", "20230101")}
    known = found.replace("open", "kept", "status")
    assert {r["status"] for r in files.rescanned(known, listing).collect()} == {"kept", "done"}


def test_manuals_of_several_folders(spark, tmp_path):
    for name, text in (("a/x.md", "one"), ("b/y.bin", "two")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    rows = files.read_manuals(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a")]).collect()
    assert sorted((r["category"], r["text"]) for r in rows if r["text"]) == [("ImportCandidate", "one")] and len(rows) == 2


def test_records(spark, tmp_path):
    document = {"documentId": "d", "text": "t", "metadata": {"product_name": "QAC", "confidence": 0.5}}
    (tmp_path / "array.json").write_text(json.dumps([document]))
    (tmp_path / "root.json").write_text(json.dumps({"documents": [document]}))
    for name in ("array.json", "root.json"):
        row = records.read_documents(spark, str(tmp_path / name)).first()
        assert (row["document_id"], row["metadata"]["product_name"]) == ("d", "QAC")
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "good.json").write_text(json.dumps({"company": "Acme", "supportNumber": "7"}))
    (tmp_path / "cases" / "bad.json").write_text("{")
    assert [r["company"] for r in records.read_case_index(spark, str(tmp_path / "cases")).collect()] == ["Acme"]


def test_a_bad_record_spares_the_rest_of_its_file(spark, tmp_path):
    text = """[
  {"company": "A", "supportNumber": "1"},
  {"company": "B" "supportNumber": "2"},
  {"company": "C, ] {", "status": [1, {"x": "]"}]},
  {"company": "D", "supportNumber": 4},
  17,
  {"status": "no company"},
  {"company": "broken},
  {"company": "E"}
]"""
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "a.json").write_text(text)
    (tmp_path / "cases" / "b.json").write_text('{"cases": [{"company": "F"}, oops, {"company": "G"}]}')
    (tmp_path / "cases" / "c.json").write_bytes(b'[{"company": "\xff"}]')
    (tmp_path / "cases" / "d.json").write_text("[]")
    (tmp_path / "cases" / "e.json").write_text('[{"company": "H"},')
    rows, faults = records.scan_records(spark, str(tmp_path / "cases"), "cases", records.CASE)
    assert sorted(r.company for r in rows.collect()) == ["A", "C, ] {", "D", "E", "F", "G", "H"]
    places = {(r.file.rpartition("/")[2], r.line, r.column): r.error for r in faults.collect()}
    assert places["a.json", 3, 19] == "Expecting ',' delimiter" and places["a.json", 6, 3] == "Expecting an object"
    assert places["a.json", 7, 3] == "Missing company" and any(k[:2] == ("a.json", 8) for k in places)
    assert ("b.json", 1, 30) in places and places["c.json", 1, 15] == "not UTF-8" and any(k[0] == "e.json" for k in places)
    assert not any(k[0] == "d.json" for k in places)
    with pytest.raises(ValueError, match="a.json, line 3, column 19"):
        records.read_records(spark, str(tmp_path / "cases" / "a.json"), "cases", records.CASE)


def test_evaluation_cases(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"evaluation_cases": [{"queryId": "q", "query": "x", "requiredTerms": ["a", "b"]}, {"query_id": "r", "expected_document_ids": ["d"]}]}))
    rows = {r.query_id: (r.query, r.required_terms, r.expected_document_ids) for r in records.read_evaluation_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert rows == {"q": ("x", ["a", "b"], None), "r": (None, None, ["d"])}


def test_payloads_of_evidence(spark, tmp_path):
    items = [{"documentId": f"d{i}", "text": "t", "product": "QAC", "version": "9", "warnings": ["w", " "]} for i in range(6)]
    items[0] = {"documentId": " ", "text": "t"}
    items[1] = {"documentId": "x", "text": "t", "product": "Other"}
    (tmp_path / "a.json").write_text(json.dumps({"query": "q", "selectedEvidence": items}))
    (tmp_path / "c.json").write_text(json.dumps({"query": "q", "selectedEvidence": [{"text": "x" * 5000}]}))
    (tmp_path / "d.json").write_text("{no")
    (tmp_path / "e.json").write_text('{"query": "q"}')
    rows, faults = records.read_payloads(spark, str(tmp_path), most=3000)
    assert {(r.file[-6:], r.error) for r in faults.collect()} == {("c.json", "too large"), ("d.json", "no JSON"), ("e.json", "no items")}
    asked = rows.withColumns({"query_id": F.lit(1), "asked_product": F.lit(" qac "), "asked_version": F.lit("10"), "ready": F.lit(True)})
    got = evidence.taken_over(asked)
    assert [(r.place, r.state) for r in got.orderBy("place").collect()] == [(0, "Incomplete"), (1, "OtherProduct"), (2, "Taken"), (3, "Taken"), (4, "Taken"), (5, "Beyond")]
    assert got.filter("place = 2").first().warnings == ["w", evidence.VERSION_WARNING]
    reason = lambda df: tuple(evidence.takeover_reasons(df).first())
    assert reason(got) == (1, 3, 2, None) and reason(evidence.taken_over(asked.withColumn("ready", F.lit(False)))) == (1, 0, 0, "BaselineNotReady")
    assert reason(evidence.taken_over(asked.filter("place < 2"))) == (1, 0, 2, "NoApplicableEvidence")
    assert evidence.taken_over(asked, 9).filter("state = 'Taken'").count() == 4


def test_a_scan_parses_what_has_changed(spark):
    """Only names of new and changed folders reach the parser, which counts them."""
    parsed = spark.sparkContext.accumulator(0)

    @F.pandas_udf(files.SCANNED.partition("record ")[2])
    def parse(paths: pd.Series) -> pd.DataFrame:
        parsed.add(len(paths))
        return pd.DataFrame({"company": paths.str[-1], "support_number": "1", "status": "s", "created_on": "d", "stamp": None})

    at = lambda *ns: spark.createDataFrame([(f"/r/{n}", datetime.datetime(2024, 1, d)) for n, d in ns], "path string, modified timestamp")
    first = written(files.cached_scan(spark.createDataFrame([], files.SCANNED), at(("a", 1), ("b", 1), ("c", 1), ("d", 1)), parse), "scan")
    assert parsed.value == 4 and {r.state for r in first.collect()} == {"parsed"}
    known = first.filter("state <> 'gone'").drop("state")
    second = written(files.cached_scan(known, at(("a", 1), ("b", 2), ("c", 1), ("e", 1)), parse), "scan")
    assert parsed.value == 4 + 2
    assert {(r.path[-1], r.state) for r in second.collect()} == {("a", "kept"), ("b", "parsed"), ("c", "kept"), ("e", "parsed"), ("d", "gone")}
    assert {r.record.company for r in second.collect()} == set("abcde")
    empty = files.cached_scan(known, at(), parse).collect()
    assert parsed.value == 6 and {r.state for r in empty} == {"gone"} and len(empty) == 4


def test_links_are_passed_over(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "n.txt").write_text("x")
    (tmp_path / "root" / "own").mkdir(parents=True)
    (tmp_path / "root" / "own" / "a.txt").write_text("a")
    (tmp_path / "root" / "b.txt").write_text("b")
    (tmp_path / "root" / "linked").symlink_to(tmp_path / "real")
    (tmp_path / "root" / "c.txt").symlink_to(tmp_path / "real" / "n.txt")
    listing = spark.createDataFrame([(f"file:{tmp_path}/root/{n}",) for n in ("own/a.txt", "b.txt", "linked/n.txt", "c.txt")] + [("s3a://bucket/c.txt",)], "path string")
    kept = {r.path.rpartition("/")[2] for r in files.without_links(listing.filter("path LIKE 'file%'"), str(tmp_path / "root")).collect()}
    assert kept == {"a.txt", "b.txt"} and files.without_links(listing.filter("path LIKE 's3%'"), str(tmp_path / "root")).count() == 1
    assert [r.text for r in files.read_notes(spark, str(tmp_path / "root")).collect()] == ["b"]


def test_reports(spark, tmp_path):
    summary = spark.createDataFrame([("fixed", 3, 0.5, ["x"], "more")], "chunk_strategy string, top_k int, mrr double, violations array<string>, extra string")
    records.write_report(summary, f"{tmp_path}/r")
    found = spark.read.option("header", True).csv(f"{tmp_path}/r/csv")
    assert found.columns == records.SUMMARY and len(records.SUMMARY) == 19 and found.first()["mrr"] == "0.5"
    assert any("0.500000" in r[0] for r in spark.read.text(f"{tmp_path}/r/markdown").collect())
