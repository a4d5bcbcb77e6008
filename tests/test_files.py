"""Sources and sinks on real files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators import profiling
from leafmill.sources import files, retention


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path


def test_a_folder_of_files_is_listed_and_routed(spark, tmp_path):
    for name, content in {"a b.pdf": b"%PDF-1.7", "Deck.PPTX": b"PK", "notes.md": "héllo", "page.html": "<p>x", "none": b"", "plus+%41.docx": b"PK", "data.csv": "a,b\n"}.items():
        put(tmp_path, name, content)
    got = {r["filename"]: (r["file_type"], r["length"]) for r in files.read_corpus(spark, str(tmp_path)).collect()}
    # a file of no bytes has no row
    assert got.keys() == {"a b.pdf", "Deck.PPTX", "notes.md", "page.html", "plus+%41.docx", "data.csv"}
    assert got["a b.pdf"] == ("pdf", 8) and got["Deck.PPTX"][0] == "pptx" and got["notes.md"] == ("txt", 6)


def test_text_files_are_read_whole(spark, tmp_path):
    put(tmp_path, "a b.txt", "one\n\ntwo é\n")
    put(tmp_path, "c+%41é.txt", "x" * 100_000)
    got = {r["filename"]: r["text"] for r in files.read_corpus(spark, str(tmp_path), "text").collect()}
    assert got == {"a b.txt": "one\n\ntwo é\n", "c+%41é.txt": "x" * 100_000}
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path), "zip")


def test_a_table_is_read_as_it_is(spark, tmp_path):
    spark.createDataFrame([(1, "t")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    assert [tuple(r) for r in files.read_corpus(spark, str(tmp_path / "docs"), "parquet").collect()] == [(1, "t")]


def test_catalogue_of_a_folder_skips_what_it_cannot_read(spark, tmp_path):
    for k, day in enumerate(["2024-01-02", "2024-03-01", "2024-02-01"]):
        put(tmp_path, f"{k}.json", json.dumps({"id": f"d{k}", "title": "T", "createdAt": day, "content": "line\nline", "other": 1}))
    put(tmp_path, "broken.json", '{"id": "d9", ')
    put(tmp_path, "anonymous.json", '{"title": "no id"}')
    put(tmp_path, "d8.txt", '{"id": "d8"}')
    got = files.read_catalogue(spark, str(tmp_path)).select("id", "content").collect()
    assert [tuple(r) for r in got] == [("d1", "line\nline"), ("d2", "line\nline"), ("d0", "line\nline")]


def test_full_texts_are_written_once_and_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 1, "only"), (3, 1, None), (1, 5000, "far")], "doc_id long, page int, text string")
    target = str(tmp_path / "out")
    files.write_fulltext(pages, target)
    got = {(r["doc_id"], r["part"]): (r["full_text"], r["preview"]) for r in spark.read.parquet(target).collect()}
    assert got[1, 0] == ("[Page 1]\nfirst\n\n[Page 2]\nsecond", "first") and got[1, 1] == ("[Page 5000]\nfar", None)
    assert got[2, 0] == ("[Page 1]\nonly", "only") and got.keys() == {(1, 0), (1, 1), (2, 0), (3, 0)}
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_fulltext(pages, target)
    files.write_fulltext(pages.filter("doc_id = 2"), target, "overwrite")
    assert spark.read.parquet(target).count() == 1


def test_sweep_of_a_real_folder(spark, tmp_path):
    now = 1_700_000_000
    for name, age in {"old.pdf": 3601, "edge.pdf": 3600, "new.pdf": 10}.items():
        os.utime(put(tmp_path, name, b"12345"), (now - age, now - age))
    listed = retention.list_files(spark, str(tmp_path))
    at = F.timestamp_seconds(F.lit(now))
    name = F.element_at(F.split("path", "/"), -1)
    assert {r[0] for r in retention.retention_sweep(listed, at).select(name).collect()} == {"old.pdf"}
    assert {r[0] for r in retention.survivors(listed, at).select(name).collect()} == {"edge.pdf", "new.pdf"}
    assert {r["size"] for r in listed.collect()} == {5}


def test_page_sizes_are_rounded(spark):
    pages = spark.createDataFrame([(1, 1, 594.96, 841.5, 90), (1, 2, None, 10.4, 0)], "doc_id long, page int, width double, height double, rotation int")
    assert sorted(map(tuple, profiling.page_sizes(pages).collect())) == [(1, 1, 595, 842, 90), (1, 2, None, 10, 0)]


def test_every_offered_payload_is_a_file_or_a_reject_with_its_reason(spark):
    import base64

    good = base64.b64encode(b"x" * 90).decode()
    bodies = [
        (1, json.dumps({"file": good, "fileName": "a.pdf", "extra": {"deep": [1]}})),
        (2, json.dumps({"pdf": [good, {"data": "data:image/gif;base64," + good, "name": "n"}, "tiny", None, {"name": "x"}, ""]})),
        (3, json.dumps({"file": "=" * 120, "data": "*" + good, "document": {"uri": "", "base64": good, "type": "image/png"}})),
        (4, "not json"), (5, None), (6, "[1]"), (7, "{}"), (8, json.dumps({"file": "", "pdf": None})), (9, ""), (10, '{"file": "' + good),
        (11, json.dumps({"file": "data:text/plain;base64," + good[:60] + "\n" + good[60:]})), (12, json.dumps({"file": 5})),
    ]
    df = spark.createDataFrame(bodies, "row_id long, body string").withColumn("_b", F.lit("clash"))
    found = files.decode_inline_files(df)
    got = {(r["row_id"], r["field"], r["item"]): (r["name"], r["mime"], bytes(r["content"])) for r in found.collect()}
    full = b"x" * 90
    assert got == {
        (1, "file", 0): ("a.pdf", "application/pdf", full), (2, "pdf", 0): ("upload.pdf", "application/pdf", full),
        (2, "pdf", 1): ("n", "image/gif", full), (3, "document", 0): ("upload.png", "image/png", full),
    }
    rejects = sorted((tuple(r) for r in files.inline_rejects(df).collect()), key=str)
    body = "body is not a JSON object"
    assert rejects == sorted([
        (2, "pdf", 2, "shorter than 100 characters"), (2, "pdf", 3, "no data"), (2, "pdf", 4, "no data"), (2, "pdf", 5, "no data"),
        (3, "file", 0, "fewer than 10 bytes"), (3, "data", 0, "not base64"), (4, None, None, body), (5, None, None, body), (6, None, None, body),
        (9, None, None, body), (10, None, None, body), (11, "file", 0, "not base64"), (12, "file", 0, "shorter than 100 characters"),
    ], key=str)
    plan = files.inline_rejects(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(file,") == 1
