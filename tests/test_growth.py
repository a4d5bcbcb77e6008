"""Work that grows with the input and no faster: even tasks, and nothing computed again and again."""

from __future__ import annotations

import base64
import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill import session
from leafmill.sources import files


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of 4 KB, as a large one is into splits of 128 MB."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, small_splits):
    rows = pa.table({"doc_id": range(2000), "text": [f"text {k * k}" for k in range(2000)]})
    pq.write_table(rows, tmp_path / "documents.parquet")
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and not session.is_even(read, 4)
    dealt = session.table(spark, str(tmp_path), "documents")
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2000 and max(held) <= 1000


def test_an_even_table_is_not_shuffled(spark, tmp_path, small_splits):
    rows = pa.table({"doc_id": range(8000), "text": [f"text {k * k}" for k in range(8000)]})
    pq.write_table(rows, tmp_path / "documents.parquet", row_group_size=250)
    plan = session.table(spark, str(tmp_path), "documents")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan


def test_payloads_are_decoded_once_for_the_rejects(spark):
    body = json.dumps({"file": base64.b64encode(b"x" * 90).decode()})
    rows = spark.createDataFrame([(1, body), (2, "no")], "row_id long, body string")
    plan = files.inline_rejects(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64") == 1


@pytest.mark.parametrize("marks", ["", "\r\n", "-_", " \t", "é𝄞", "=", "***"])
def test_foreign_characters_are_skipped(spark, marks):
    raw = bytes(range(256)) * 3
    text = base64.b64encode(raw).decode().rstrip("=")
    if marks == "-_":
        text = text.replace("+", "-").replace("/", "_")
    else:
        text = marks.join(text[k : k + 50] for k in range(0, len(text), 50)) + marks
    got = spark.createDataFrame([(text,), (text + "A" * ((5 - len(raw) * 4 // 3 % 4) % 4),), (None,)], "c string").select(files.decode_base64(F.col("c"))).collect()
    assert bytes(got[0][0]) == raw and bytes(got[1][0])[: len(raw)] == raw and got[2][0] is None


def test_terms_are_those_of_the_patterns(spark):
    import re

    from leafmill.functions.text import WS_CHARS, tokens_of

    texts = ["", "a b", "The Quick, brown--fox 12x3 x.y.z", "Ünï çode ÉCOLE straße 𝄞abc𝄞 İstanbul", f"one{WS_CHARS}two" + "​three\x85four\x1cfive", "\\ $1 ^-] [a-z]", None]
    texts += [f"ab{ch}cd{ch}ef gh" for ch in WS_CHARS + "​᠎\x00\x7f́"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("t", F.lower("t").alias("low"), tokens_of(F.col("t")).alias("w")).collect()
    for r in got:
        wanted = None if r["t"] is None else [w for w in (re.sub("[^a-z0-9]", "", x) for x in re.split(f"[{re.escape(WS_CHARS)}]+", r["low"])) if len(w) >= 3]
        assert r["w"] == wanted, r["t"]


def test_first_places_are_found_without_sorting_all_rows(spark):
    from leafmill.operators import diffing, lexical

    chunks = spark.createDataFrame([(1, 0, "one two two"), (1, 1, "six two one"), (2, 0, None)], "doc_id long, chunk_id int, text string")
    vocab = lexical.vocab_topn(lexical.chunk_terms(chunks), chunks, 8, 1.0)
    assert [(r["term"], r["df"]) for r in vocab.orderBy("idx").collect()] == [("one", 2), ("two", 2), ("six", 1)]
    a = spark.createDataFrame([(1, 2, "late x"), (1, 1, "x soon"), (1, None, "none")], "doc_id long, page int, text string")
    b = spark.createDataFrame([(1, 1, "x new")], "doc_id long, page int, text string")
    diffs = diffing.word_diffs(a, b)
    assert sorted(tuple(r) for r in diffs.collect()) == [(1, "only_a", 1, "none"), (1, "only_a", 2, "soon"), (1, "only_a", 3, "late"), (1, "only_b", 1, "new")]
    for df in (vocab, diffs):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_citations_are_found_once_for_a_bibliography(spark):
    from leafmill.operators import citations

    docs = spark.createDataFrame([(1, "References\n[1] Doe, A. (1999). A first long title. MIT Press.\n[2] Roe, B. (2001). A second long title. MIT Press.")], "doc_id long, text string")
    found = citations.bibliography(citations.parse_entries(citations.split_entries(docs)), "mla")
    assert [r["n"] for r in found.orderBy("n").collect()] == [1, 2]
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_counted_once_for_all_readers(spark):
    from leafmill.operators.cleaning import drop_repeated_lines

    rows = [("a", k, f"HEAD\nbody {k * k}") for k in range(1, 9)] + [("b", 1, "HEAD\nx"), (None, 2, "HEAD\ny")]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id string, page int, text string"))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["page"]): r["text"] for r in got.collect()} == {
        (d, p): t.split("\n")[1] if d == "a" else t for d, p, t in rows
    }


def test_large_pages_are_cut_as_a_reader_would(spark):
    from leafmill.operators.chunking import piece_starts, split_large_page

    texts = ["x" * 90, "", "\n\n\nab\n\ncd", "\n\n".join(c * n for c, n in zip("abcdefgh", (5, 40, 3, 60, 7, 7, 90, 1))), "a\n\n \n\n" + "b" * 60 + "\n\n"]

    def expected(page, text, most):
        cur, out = f"[Page {page}]\n", []
        for para in re.split("\n{2,}", text):
            if len(cur) + len(para) > most and len(cur) > 20:
                out.append(cur.strip())
                cur = f"[Page {page} continued]\n"
            cur += para + "\n\n"
        return [*out, cur.strip()]

    rows = spark.createDataFrame([(k, k + 7, t) for k, t in enumerate(texts)], "id int, page int, text string")
    pieces = split_large_page(F.col("page"), F.col("text"), 50)
    starts = piece_starts(F.col("page"), F.split("text", "\n{2,}"), 50)
    for r in rows.select("page", "text", pieces.alias("pieces"), F.size(starts).alias("n")).collect():
        assert r["pieces"] == expected(r["page"], r["text"], 50) and r["n"] == len(r["pieces"])


def test_words_asked_are_counted_as_among_all(spark, monkeypatch):
    from leafmill.operators import lexical

    monkeypatch.setattr(lexical, "ASKED", 2)
    chunks = spark.createDataFrame([(1, 0, "Red fox red DEN owl"), (1, 1, "owl owl"), (2, 0, "red fox"), (None, 0, "red")], "doc_id int, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "red"), (1, "red"), (1, "owl"), (1, "den"), (1, "none"), (2, "owl"), (None, "red")], "doc_id int, term string")
    whole = {tuple(r) for r in lexical.chunk_terms(chunks).join(asked.distinct(), ["doc_id", "term"], "left_semi").select("doc_id", "chunk_id", "term", "tf", "first_pos", "n_tokens").collect()}
    got = [tuple(r) for r in lexical.chunk_terms(chunks, asked=asked).select("doc_id", "chunk_id", "term", "tf", "first_pos", "n_tokens").collect()]
    assert len(got) == len(set(got)) == 4 and set(got) == whole
