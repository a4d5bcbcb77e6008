"""Nothing is cut unless a limit is asked for, and the cases a first version got wrong."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import blocks
from leafmill.operators import chunking, citations, diffing, grounding, pagesets, profiling, responses, retrieval, search, structure


def test_a_long_document_keeps_all_its_parts(spark):
    text = " ".join(f"w{k}" for k in range(9000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = [r["text"] for r in chunking.chunk_overlap(docs, 2000, 100).orderBy("chunk_no").collect()]
    assert len(parts) > 12 and text.endswith(parts[-1])
    at = 0
    for p in parts:  # each part overlaps or follows the one before it
        found = text.index(p, max(0, at - 200))
        assert found <= at
        at = found + len(p)
    assert at == len(text)
    assert chunking.chunk_overlap(docs, 2000, 100, 3).count() == 3


def test_more_than_twenty_changed_segments(spark):
    pages = lambda word: spark.createDataFrame([(1, 1, ". ".join(f"{word} {k}" for k in range(30)))], "doc_id long, page int, text string")
    whole = diffing.page_diffs(pages("a"), pages("b")).first()
    cut = diffing.page_diffs(pages("a"), pages("b"), max_segments=20).first()
    assert len(whole["removed"]) == len(whole["added"]) == 30 and len(cut["removed"]) == 20


def test_pages_of_two_documents_are_two_pages(spark):
    rows = [(d, 1, profiling.ANNOTATION_TYPES[0]) for d in (1, 1, 2)]
    got = profiling.annotation_breakdown(spark.createDataFrame(rows, "doc_id long, page int, type string"))
    assert [tuple(r) for r in got.where("doc_id IS NULL").select("count", "pages").collect()] == [(3, 2)]


def test_the_last_of_two_values_fills_a_field(spark):
    fields = spark.createDataFrame([(1, "name", "text", ["old"], None)], "doc_id long, name string, type string, values array<string>, options array<string>")
    values = spark.createDataFrame([(1, "name", "z", 1), (1, "name", "a", 2)], "doc_id long, name string, value string, no int")
    assert [r["value"] for r in profiling.fill_form(fields, values, order="no")[0].collect()] == ["a"]
    assert [r["value"] for r in profiling.fill_form(fields, values)[0].collect()] == ["z"]


def test_keys_on_one_side_are_reported(spark):
    side = lambda *rows: spark.createDataFrame(rows, "doc_id long, content string")
    got = search.change_audit(side((1, "a"), (2, "b")), side((1, "a"), (3, "c"))).select("doc_id", "status", "changed").collect()
    assert sorted(map(tuple, got)) == [(1, "both", False), (2, "before only", True), (3, "after only", True)]


def test_lists_and_lines_are_whole(spark):
    fields = "insights strengths weaknesses recommendations topics".split()
    schema = "doc_id long, part int, sentiment_score double, " + ", ".join(f"{f} array<string>" for f in fields)
    parts = spark.createDataFrame([(1, 0, 0.5, *[[f"{f}{k}" for k in range(12)] for f in fields])], schema)
    assert all(len(responses.merge_analyses(parts).first()[f]) == 12 for f in fields)
    assert len(responses.merge_analyses(parts, responses.LIST_CAPS).first()["topics"]) == 6
    lines = spark.createDataFrame([(1, "\n".join(f"- line {c}" for c in "abcdefgh"))], "resp_id long, content string")
    assert responses.summary_lines(lines).count() == 8 and responses.summary_lines(lines, 5).count() == 5


def test_every_document_has_a_context(spark):
    chunks = spark.createDataFrame([(1, 0, "aaa"), (1, 5000, "bbb"), (2, 0, "x" * 50), (2, 1, "y"), (3, 0, " "), (3, 9, "ccc"), (4, 0, None)], "doc_id long, chunk_id int, text string")
    want = {1: "aaa\n\nbbb", 2: "", 3: "ccc", 4: ""}
    for sampled in (False, True):
        assert {r["doc_id"]: r["context"] for r in retrieval.sample_context(chunks, budget=20, sampled=sampled).collect()} == want


def test_pages_stand_in_for_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "aaa")], "doc_id long, chunk_id int, text string")
    pages = spark.createDataFrame([(1, 1, "no"), (2, 1, " "), (2, 7, " seven ")], "doc_id long, page int, text string")
    got = retrieval.chunks_or_pages(chunks, pages).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "aaa"), (2, 0, "[Page 7]\nseven")]


def test_zero_places_are_filled_with_gaps_in_the_ids(spark):
    chunks = spark.createDataFrame([(1, 0, "aaa"), (1, 50, "bbb"), (1, 90, "needle")], "doc_id long, chunk_id int, text string")
    queries = spark.createDataFrame([(7, 1, "needle")], "query_id long, doc_id long, question string")
    from leafmill.operators.lexical import chunk_terms

    got = retrieval.keyword_topk(queries, chunk_terms(chunks), chunks, 3).collect()
    assert sorted((r["chunk_id"], r["score"]) for r in got) == [(0, 0), (50, 0), (90, 1)]


def test_inputs_out_of_bounds_are_rejects(spark):
    inputs = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, ""), (4, None)], "id long, content string")
    cache = spark.createDataFrame([("h", "r", 1)], "hash string, result string, size int")
    hits, misses, rejects = pagesets.content_cache(inputs, cache, 3)
    assert hits.count() == 0 and [r["id"] for r in misses.collect()] == [1]
    assert sorted(map(tuple, rejects.collect())) == [(2, 4, "too large"), (3, 0, "empty"), (4, 0, "empty")]


def test_two_cached_rows_of_one_hash_give_one_hit(spark):
    inputs = spark.createDataFrame([(1, "abc")], "id long, content string")
    twice = inputs.select(F.sha2("content", 256).alias("hash"), F.explode(F.array(F.lit(1), F.lit(2))).alias("size"))
    hits = pagesets.content_cache(inputs, twice.withColumn("result", F.col("size").cast("string")))[0]
    assert [r["result"] for r in hits.collect()] == ["2"]


def test_references_after_a_run_of_blanks(spark):
    text = "Body text.    References     [1] Adams, A. (2001). One. [1] not"
    got = citations.reference_texts(spark.createDataFrame([(1, text), (2, "a    b"), (3, None)], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "[1] Adams, A. (2001). One. [1] not", 2: "a    b", 3: None}


def test_all_authors_are_kept(spark):
    names = [f"Name{c}, {c}." for c in "ABCDEFGHI"]
    raw = ", ".join(names) + " (2001). A title. Some Press."
    entries = spark.createDataFrame([(1, 1, raw)], "doc_id long, entry_no int, raw string")
    row = citations.parse_entries(entries).first()
    assert len(row["authors"]) == 9
    assert len(citations.parse_entries(entries, max_authors=6).first()["authors"]) == 6
    assert citations.bibliography(citations.parse_entries(entries), "mla").first()["formatted"].startswith("NameA, A., et al.")
    assert "NameI, I." in citations.bibliography(citations.parse_entries(entries), "apa").first()["formatted"]


def test_html_lines_have_types(spark):
    html = "<style>x</style>\n\n<h1>Top &amp; <b>more</b></h1>\n\n\n<p>one<br>two</p><ul><li>item</li></ul><H2 id='a'></H2>\n \n"
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<h3>a<br/>b</h3>")], "page_id long, html string")
    got = structure.html_blocks(pages).orderBy("page_id", "line_no").collect()
    rows = lambda k: [(r["block_type"], r["text"]) for r in got if r["page_id"] == k]
    assert rows(1) == [("h1", "Top & **more**"), ("blank", ""), ("text", "one"), ("text", "two"), ("blank", ""), ("text", "• item"), ("blank", ""), ("h2", "")]
    assert rows(2) == [("blank", "")] and rows(3) == [] and rows(4) == [("h3", "a"), ("text", "b")]


def test_all_highlights_are_kept(spark):
    rows = [(1, k, f"finding number {k} of its own kind k{k}", "high", 50) for k in range(40)]
    marks = spark.createDataFrame(rows, "doc_id long, hl_id int, text string, importance string, confidence int")
    assert grounding.merge_highlights(marks).count() == 40 and grounding.merge_highlights(marks, 10).count() == 10


def test_all_differing_words_are_kept(spark):
    pages = lambda w: spark.createDataFrame([(1, 1, " ".join(f"{w}{k}" for k in range(150)))], "doc_id long, page int, text string")
    assert diffing.word_diffs(pages("a"), pages("b")).count() == 300 and diffing.word_diffs(pages("a"), pages("b"), 10).count() == 20


def test_long_headings_and_raw_entries_are_whole(spark):
    long = "Heading of many words " * 8 + "end"
    parts = spark.createDataFrame([(1, 1, f"<h2>{long}</h2><p>text of it</p>")], "doc_id long, pos int, html string")
    assert structure.html_chapters(parts).first()["chapter_title"] == long
    assert structure.html_chapters(parts, 100).first()["chapter_title"] == long[:100]
    row = spark.range(1).selectExpr("*", "cast(array() as array<struct<last:string,first:string>>) AS authors", f"'{long}' AS raw", "'unknown' AS type", *[f"'' AS {c}" for c in "title year volume issue pages url journal publisher doi".split()])
    for style in citations.STYLES:
        assert long in row.select(citations.format_citation(style)).first()[0]
        assert long not in row.select(citations.format_citation(style, 100)).first()[0]


def test_overlapping_parts_follow_the_rule_step_by_step(spark):
    rng = np.random.default_rng(2)
    marks = np.array([" ", ". ", "\n", "\n\n", "é", "漢字", "x" * 40])
    texts = ["".join(rng.choice(marks, n, p=[0.1, 0.05, 0.03, 0.02, 0.3, 0.2, 0.3])) for n in (0, 1, 300, 900, 4000)] + ["y" * 20_001, "z" * 2000, None]

    def brute(text):
        out, at, text = [], 0, text or ""
        while at >= 0:
            end = min(at + 2100, len(text))
            if end < len(text):
                tail = text[end - 2000 : end]
                best = max(tail.rfind(m) for m in ("\n\n", ". ", "\n", " "))
                end = end - 2000 + best if best > 0 and 2000 - best < 1500 else end
            out.append(text[at:end])
            at = -1 if end >= len(text) else max(end - 150, at + 1)
        return out

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in chunking.chunk_overlap(docs, 2100, 150).collect())
    assert got == [(i, k, p) for i, t in enumerate(texts) for k, p in enumerate(brute(t))]


def test_cutting_takes_time_in_proportion_to_the_text():
    import time

    def seconds(n):
        text = "some words. " * (n // 12)
        start = time.process_time()
        parts = sum(1 for _ in chunking.part_cuts(text, 2000, 100))
        return (time.process_time() - start) / parts

    seconds(1 << 20)
    assert seconds(16 << 20) < 4 * seconds(1 << 20)


def test_pages_after_a_gap_stay(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 5000, "b"), (2, 1, "c"), (2, 9000, "d")], "doc_id long, page int, text string")
    order = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "out_id long, pos int, doc_id long")
    joined = pagesets.concat_docs(pages, order).select("page", "text").collect()
    assert sorted(map(tuple, joined)) == [(1, "a"), (5000, "b"), (5001, "c"), (14000, "d")]
    ranges = spark.createDataFrame([(1, 1, [1]), (2, 1, [1])], "doc_id long, part int, pages array<int>")
    split = pagesets.split_docs(pages, ranges, tail=True).select("doc_id", "part", "source_page").collect()
    assert sorted(map(tuple, split)) == [(1, 1, 1), (1, 2, 5000), (2, 1, 1), (2, 2, 9000)]


def test_long_page_numbers_are_read_whole(spark):
    df = spark.createDataFrame([(1, "0000000012"), (2, "1234567890123"), (3, "19-99999999999"), (4, "+000, 0-2"), (5, "00003-000000000004")], "doc_id long, selector string")
    counts = spark.createDataFrame([(k, 20) for k in range(1, 6)], "doc_id long, pages int")
    got = sorted(tuple(r) for r in pagesets.page_selector(df, counts).collect())
    assert got == [(1, 12), (3, 19), (3, 20), (4, 1), (4, 2), (5, 3), (5, 4)]


def test_matches_are_cut_from_the_line_as_written(spark):
    lines = spark.createDataFrame([(1, 1, "İİ cat DOG dog"), (1, 2, "dog")], "doc_id long, line_no int, text string")
    got = search.find_matches(lines, ["dog"]).select("line_no", "start", "matched").collect()
    assert sorted(map(tuple, got)) == [(1, 7, "DOG"), (1, 11, "dog"), (2, 0, "dog")]


def test_marks_in_a_text_make_no_sections(spark):
    text = "one ﷐two﷑ three﷒ four ﷓five ﷔s ﷔0\n\nINTRODUCTION:\nsix ﷔"
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    got = structure.paragraphs(pages).orderBy("paragraph_index").select("section", "text").collect()
    assert list(map(tuple, got)) == [(None, "one ﷐two﷑ three﷒ four ﷓five ﷔s ﷔0"), ("INTRODUCTION", "six ﷔")]


def fitted(heights, band):
    """First line, in order of opening, less than `band` away: every line is looked at for every height."""
    lines, out = [], {}
    for y in heights:
        near = [line for line in lines if abs(line - y) < band]
        if not near:
            lines.append(y)
        out.setdefault(y, near[0] if near else y)
    return out


@pytest.mark.parametrize("band", [5.0, 0.3, 1000.0, 0.0])
def test_first_fit_lines_are_those_of_the_plain_rule(spark, band):
    rng = random.Random(7)
    pages = {p: list(dict.fromkeys(round(rng.uniform(-40, 40), rng.choice([0, 1, 5])) for _ in range(n))) for p, n in enumerate([1, 2, 30, 200])}
    rows = [(1, p, y, n) for p, ys in pages.items() for n, y in enumerate(ys)] + [(1, 0, None, 99)]
    got = structure.first_fit(spark.createDataFrame(rows, "doc_id long, page int, y double, seq int"), ["doc_id", "page"], band).collect()
    found = {p: {r["y"]: r["line_y"] for r in got if r["page"] == p} for p in pages}
    assert found == {p: fitted(ys, band) for p, ys in pages.items()}
    assert len(got) == sum(map(len, pages.values()))


def test_a_page_of_a_hundred_thousand_heights_is_fitted_without_a_fold(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("seq"), (F.col("id") * 4.0).alias("y"))
    lines = structure.first_fit(rows, ["doc_id", "page"], 5.0)
    # heights come four apart: every second one opens a line
    assert lines.filter(F.col("line_y") != F.floor(F.col("y") / 8) * 8).count() == 0 and lines.count() == n


def test_heights_that_are_no_numbers_have_their_own_lines(spark):
    rows = [(1, 1, float("nan"), 0), (1, 1, float("inf"), 1), (1, 1, 1.0, 2), (1, 1, 2.0, 3), (1, 1, float("-inf"), 4)]
    got = structure.first_fit(spark.createDataFrame(rows, "doc_id long, page int, y double, seq int"), ["doc_id", "page"], 5.0).collect()
    assert sorted(str(r["line_y"]) for r in got) == ["-inf", "1.0", "1.0", "inf", "nan"]


def test_short_snippets_are_found_by_comparing_and_by_the_vocabulary(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    paras = [(d, k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for d in (1, 2) for k in range(150)]
    asked, n = [], 0
    for d, _, text in rng.choices(paras, k=200):
        a = rng.randrange(max(1, len(text) - 8))
        asked.append((d, n := n + 1, text[a : a + 8 + rng.randrange(6)]))
    asked += [(1, n + 1, "zzzzzzzzz"), (1, n + 2, ". . . . . a"), (None, n + 3, "abcabcabc"), (2, n + 4, None), (3, n + 5, "abababab")]
    snippets = spark.createDataFrame(asked, "doc_id long, snippet_id int, snippet string")
    table = spark.createDataFrame([(d, k, 1, None, t) for d, k, t in paras], "doc_id long, paragraph_index int, page int, section string, text string")
    ways = [sorted(map(str, grounding.locate_snippets(snippets, table, bound).collect())) for bound in (0, 1 << 40)]
    assert ways[0] == ways[1] and len(ways[0]) > 100

    # brute force of the index alone: every paragraph that contains the needle is among the pairs
    needles = [(d, i, s.split()) for d, i, s in asked if d in (1, 2) and s and s.split() and len(s.split()) <= 2]
    postings = spark.createDataFrame([(d, k, w) for d, k, t in paras for w in set(t.split())], "doc_id long, pid int, w string")
    pairs = grounding.word_part_pairs(spark.createDataFrame(needles, "doc_id long, nid int, nw array<string>"), postings).collect()
    longest = {i: max(ws, key=lambda w: (len(w), w)) for _, i, ws in needles}
    want = {(d, i, k) for d, i, _ in needles for e, k, t in paras if d == e and longest[i] in t}
    assert {tuple(p) for p in pairs} == want
    assert {(d, i, k) for d, i, ws in needles for e, k, t in paras if d == e and " ".join(ws) in t} <= want


def test_copies_follow_the_rows_of_a_key(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") < 20, -1).otherwise(F.col("id")).alias("k"), "id")
    nulls = spark.range(9000).select(F.lit(None).cast("long").alias("k"), (F.col("id") + 30000).alias("id"))
    both = rows.unionByName(nulls)
    hot = blocks.hot_keys(both, ["k"], shares=64, least=100)
    hashes = {r["k"]: r["h"] for r in spark.createDataFrame([(7,), (-1,), (None,)], "k long").select("k", F.xxhash64("k").alias("h")).collect()}
    # 10000 and 9000 rows at shares of 39000 / 64 rows; a key with ten rows or so has one copy
    assert hot == {hashes[7]: 17, hashes[None]: 15}
    lookup = spark.createDataFrame([(7, "a"), (7, "b"), (-1, "c"), (None, "d"), (10**6, "e")], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        got = blocks.spread_join(both, lookup, ["k"], F.col("id"), how, shares=64, least=100)
        want = both.join(lookup, ["k"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert blocks.hot_keys(both.limit(0), ["k"]) == {}


@pytest.mark.parametrize("mode", ["anchor", "first_fit"])
def test_heights_of_lines_are_never_broadcast(spark, mode):
    items = spark.createDataFrame(
        [(1, 1, k, f"w{k}", float(k), 700.0 - 8 * k, 5.0, 10.0) for k in range(20)], "doc_id long, page int, seq int, text string, x double, y double, w double, h double"
    )
    lines = structure.items_to_lines(items, mode).drop("items")
    joins = [x for x in lines._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and ("_down" in x or "y#" in x)]
    assert any("SortMergeJoin" in x for x in joins) and not any("BroadcastHashJoin" in x for x in joins)
    assert lines.count() == 20


def test_long_snippets_are_found_by_comparing_and_by_the_indexes(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    paras = [(d, k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for d in (1, 2) for k in range(60)]
    asked = []
    for n, (d, _, text) in enumerate(rng.choices(paras, k=120)):
        a = rng.randrange(max(1, len(text) - 8))
        piece = text[a : a + 8 + rng.randrange(60)]
        asked.append((d, n, piece if n % 3 else piece.replace(" ", " zebra ", 1)))
    snippets = spark.createDataFrame(asked, "doc_id long, snippet_id int, snippet string")
    table = spark.createDataFrame([(d, k, 1, None, t) for d, k, t in paras], "doc_id long, paragraph_index int, page int, section string, text string")
    ways = [sorted(map(str, grounding.locate_snippets(snippets, table, bound).collect())) for bound in (0, 1 << 40)]
    assert ways[0] == ways[1] and len(ways[0]) > 60
    # few pairs are compared in place: no snippet or paragraph is unpacked into grams that are shuffled
    plan = grounding.locate_snippets(snippets, table)._jdf.queryExecution().optimizedPlan().toString()
    unpacked = [x for x in plan.splitlines() if "Generate explode" in x]
    assert len(unpacked) == 1 and "xxhash64" not in unpacked[0].split("filter")[0]


def test_grams_of_highlights_travel_as_numbers(spark):
    rows = [(d, k, f"a b c d e f g h i j k{k // 2}" + " x" * (k % 2), "high", k) for d in (1, 2) for k in range(20)]
    highlights = spark.createDataFrame(rows, "doc_id long, hl_id int, text string, importance string, confidence int")
    merged = grounding.merge_highlights(highlights)
    schemas = {f.name: f.dataType.simpleString() for x in merged.inputFiles() for f in spark.read.parquet(x).schema}
    assert schemas["g"] == "bigint" and schemas["gs"] == "array<bigint>"
    assert [tuple(r) for r in merged.select("doc_id", "hl_id", "position").orderBy("doc_id").collect()] == [(1, 19, 1), (2, 19, 1)]


def test_audit_of_empty_content(spark):
    rows = lambda *r: spark.createDataFrame(r, "doc_id int, content string")
    before = rows((1, ""), (2, ""), (3, "abcd"), (4, None), (5, ""))
    after = rows((1, ""), (2, "xy"), (3, "abc"), (4, "x"))
    got = {r["doc_id"]: (r["input_size"], r["output_size"], str(r["reduction_pct"])) for r in search.change_audit(before, after).collect()}
    assert got == {1: (0, 0, "nan"), 2: (0, 2, "-inf"), 3: (4, 3, "25.0"), 4: (None, 1, "None"), 5: (0, None, "None")}


@pytest.mark.parametrize("mode", ["anchor", "first_fit"])
def test_lines_of_packed_pages_are_those_of_blocks(spark, mode):
    rng = random.Random(9)
    rows = []
    for doc, page in [(1, 1), (1, 2), (2, 1), (None, 1), (3, None), (3, 4)]:
        for k in range(80):
            y = rng.choice([None, 0.0, -0.0, rng.uniform(-60, 60), rng.randint(-9, 9) * 1000.0]) if k % 7 else 5.5
            rows.append((doc, page, rng.randrange(60), rng.choice(["a", " b", "", None, "é ", "cd"]), float(rng.randrange(9)), y, rng.choice([None, 6.0]), 10.0))
    rows += [(4, 1, None, "n", 1.0, 2.0, 1.0, 1.0), (4, 1, 2, "m", None, 2.0, 1.0, 1.0), (5, 1, 1, "o", float("nan"), 1.0, 1.0, 1.0), (6, 1, 1, "p", 1.0, 1.0, 1.0, 1.0)]
    items = spark.createDataFrame(rows, "doc_id int, page int, seq int, text string, x double, y double, w double, h double")
    ways = [sorted(map(str, structure.items_to_lines(items, mode, per_page=n).collect())) for n in (0, 60, 1 << 17)]
    assert len(ways[0]) > 30 and ways[0] == ways[1] == ways[2]
    plan = structure._lines_together(items, mode, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    # a column that is never null
    assert structure.items_to_lines(items.withColumn("h", F.lit(10.0)), mode).count() == len(ways[0])
