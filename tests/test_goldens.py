"""Worked cases, derived by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions.blocks import NO_ANCHOR, block_anchors, block_steps
from leafmill.functions.matching import fold
from leafmill.operators import chunking, cleaning, grounding, lexical, pagesets, profiling, retrieval, search
from leafmill.operators.cleaning import clean_text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, "foo\n\n12\n\nbar", clean_text) == "foo\n\nbar"
    assert one(spark, "exam-\nple", clean_text) == "example"


def test_chunk_pages_with_large_page(spark):
    pages = [(1, "a" * 30), (2, "b" * 30), (3, ""), (4, "c" * 20 + "\n\n" + "d" * 50 + "\n\n" + "e" * 10), (5, "f" * 5)]
    df = spark.createDataFrame([(7, p, t) for p, t in pages], "doc_id bigint, page int, text string")
    got = [tuple(r) for r in chunking.chunk_pages(df, 60).orderBy("chunk_id").select("chunk_id", "text", "pages").collect()]
    assert got == [
        (0, "[Page 1]\n" + "a" * 30, [1]),
        (1, "[Page 2]\n" + "b" * 30, [2]),
        (2, "[Page 4]\n" + "c" * 20, [4]),
        (3, "[Page 4 continued]\n" + "d" * 50, [4]),
        (4, "[Page 4 continued]\n" + "e" * 10, [4]),
        (5, "[Page 5]\n" + "f" * 5, [5]),
    ]


def greedy_chunks(pages, limit):
    """Plain re-statement of the packing rule for small pages."""
    out, cur, held = [], "", []
    for page, text in pages:
        block = f"[Page {page}]\n{text}"
        if cur and len(cur) + len(block) > limit:
            out.append((cur, held))
            cur, held = "", []
        cur, held = (cur + "\n\n" + block) if cur else block, held + [page]
    return out + ([(cur, held)] if cur else [])


def test_chunks_spanning_page_blocks(spark, monkeypatch):
    """A document of many blocks gives the chunks of one walk through all its pages."""
    monkeypatch.setattr(chunking, "PAGES_PER_BLOCK", 4)
    rng = np.random.default_rng(5)
    pages = [(p, "x" * int(n)) for p, n in enumerate(rng.integers(1, 60, 101), start=1)]
    df = spark.createDataFrame([("hot", p, t) for p, t in pages] + [("small", 1, "tiny")], "doc_id string, page int, text string")
    got = [(r["text"], r["pages"]) for r in chunking.chunk_pages(df, 200).filter("doc_id = 'hot'").orderBy("chunk_id").collect()]
    assert got == greedy_chunks(pages, 200)


@pytest.mark.parametrize("seed", range(20))
def test_block_steps_agree_with_replay(seed):
    """A block's step function gives the anchor that replaying the block leaves open."""
    rng = np.random.default_rng(seed)
    a = np.cumsum(rng.integers(1, 9, 40)).astype(float)
    hard = rng.random(40) < 0.1
    limit = 20.0
    breaks, exits = block_steps(a, a, hard, limit)
    for entry in [NO_ANCHOR, *(a[0] - k for k in range(1, 30))]:
        value = exits[int(np.searchsorted(np.asarray(breaks), entry + limit, side="right"))]
        value = entry if np.isnan(value) else value
        anchors = block_anchors(a, a, hard, limit, entry)
        assert value == (NO_ANCHOR if hard[-1] else anchors[-1])


def test_chunk_overlap_lengths(spark):
    df = spark.createDataFrame([(1, " ".join(["word"] * 1000))], "doc_id bigint, text string")
    lengths = lambda n: [len(r["text"]) for r in chunking.chunk_overlap(df, 2000, 100, n).orderBy("chunk_no").collect()]
    assert lengths(12) == [1999, 1995, 1205]
    assert lengths(2) == [1999, 3202]


def test_vocabulary_and_weights(spark):
    df = spark.createDataFrame(
        [(1, 0, "cat cat dog"), (1, 1, "dog bird"), (1, 2, "fish dog bird"), (2, 0, "only one text")], "doc_id bigint, chunk_id int, text string"
    )
    terms = lexical.chunk_terms(df)
    vocab = lexical.vocab_topn(terms, df)
    assert [(r["term"], r["df"]) for r in vocab.orderBy("idx").collect()] == [("bird", 2), ("cat", 1), ("fish", 1)]
    weights = {(r["chunk_id"], r["term"]): round(r["weight"], 6) for r in lexical.tfidf_weights(terms, vocab).collect()}
    assert weights == {(0, "cat"): 1.0, (1, "bird"): 1.0, (2, "fish"): 0.938145, (2, "bird"): 0.346242}


def test_fold_and_threshold(spark):
    assert one(spark, "Café “net” — it’s 5%", fold) == "cafe net it s 5"
    paras = spark.createDataFrame(
        [(1, 1, 0, None, "The quick brown fox jumps over")], "doc_id bigint, page int, paragraph_index int, section string, text string"
    )
    asked = spark.createDataFrame([(1, 0, "quick brown fox jumps high"), (1, 1, "uick brown fo")], "doc_id bigint, snippet_id int, snippet string")
    got = grounding.locate_snippets(asked, paras).collect()
    assert [(r["snippet_id"], r["score"]) for r in got] == [(1, 13)]


def test_overlapping_and_plain_hits(spark):
    lines = spark.createDataFrame([(1, 1, "aaaa")], "doc_id bigint, line_no int, text string")
    assert [r["start"] for r in search.find_matches(lines, ["aa"]).orderBy("start").collect()] == [0, 1, 2]
    blocks = spark.createDataFrame([(1, 1, "aaaa")], "doc_id bigint, block_no int, content string")
    assert search.count_hits(blocks, ["aa"]).first()["hits"] == 2


def test_pack_context(spark):
    def context(lengths, budget, partial):
        df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate(lengths)], "query_id bigint, chunk_id int, text string")
        return retrieval.pack_context(df, budget, partial).first()["context"]

    strict = context([6000, 5000, 2000], 12_000, False)
    assert len(strict) == 11_012 and strict.endswith("\n\n---")
    cut = context([9000, 6000], 14_000, True)
    assert len(cut) == 13_998 and cut.endswith("...\n\n---")


def test_page_selector(spark):
    asked = spark.createDataFrame([(1, "1-3,5,x,99")], "doc_id bigint, selector string")
    counts = spark.createDataFrame([(1, 6)], "doc_id bigint, pages bigint")
    assert sorted(r["page"] for r in pagesets.page_selector(asked, counts).collect()) == [1, 2, 3, 5]


def test_confidence_and_colours(spark):
    df = spark.createDataFrame([("abc",), ("-4",), ("140",), ("62.5",), (None,)], "c string")
    assert [r[0] for r in df.select(grounding.clamp_confidence(F.col("c"))).collect()] == [75, 0, 100, 63, 0]
    colors = spark.createDataFrame([([1.0, 1.0, 0.0],), ([1.0, 0.0, 0.0],), ([0.5, 0.5, 0.5],), ([],)], "c array<double>")
    assert [r[0] for r in colors.select(profiling.color_name(F.col("c"))).collect()] == ["yellow", "red", "custom", "unknown"]


def test_page_without_lines_survives(spark):
    df = spark.createDataFrame([(1, p, "HEADER" if p == 2 else f"HEADER\nbody {p}") for p in (1, 2, 3)], "doc_id bigint, page int, text string")
    got = {r["page"]: r["text"] for r in cleaning.drop_repeated_lines(df).collect()}
    assert got == {1: "body 1", 2: "", 3: "body 3"}
