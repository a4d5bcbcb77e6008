"""Early-stopping hybrid ranking against dense scoring, on documents of many runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import lexical, postings, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    """One document of 900 chunks holds most rows; a few words are everywhere, the asked ones cluster."""
    rng = np.random.default_rng(4)
    rows = []
    for doc, n in ((1, 900), (2, 7), (3, 1)):
        for c in range(n):
            words = ["common"] * int(rng.integers(1, 4)) + [f"w{rng.integers(60)}" + "x" * 2 for _ in range(12)]
            if doc == 1 and 400 <= c < 412:
                words += ["harbour"] * 6 + ["lantern"] * int(c - 398)
            rows.append((doc, c, " ".join(words), [c]))
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, pages array<int>")
    asked = [(10, 1, "harbour lantern common"), (11, 1, "harbour, w1xx lantern!"), (12, 2, "common w3xx w3xx"), (13, 3, "nothing here"), (14, 1, ""), (15, 1, "absent words"), (16, 2, None)]
    queries = spark.createDataFrame(asked, "query_id long, doc_id long, question string")
    terms = lexical.chunk_terms(chunks)
    return chunks, queries, terms, lexical.vocab_topn(terms, chunks, 80)


def rounded(df):
    rows = df.select("query_id", "doc_id", "chunk_id", "score", "embedding_score", "keyword_score").collect()
    return sorted((r[0], r[1], r[2], *(round(x, 9) + 0.0 for x in r[3:])) for r in rows)


@pytest.mark.parametrize("block, k", [(64, 6), (8, 3), (1, 4), (2000, 5)])
def test_listed_ranking_equals_dense_ranking(corpus, block, k):
    chunks, queries, terms, vocab = corpus
    dense = retrieval.hybrid_topk(lexical.query_vectors(queries, vocab, 80, "corpus"), lexical.tfidf_vectors(chunks, 80, terms=terms, vocab=vocab), k)
    asked = postings.query_terms(queries, vocab)
    listed = postings.hybrid_topk_postings(asked, postings.posting_blocks(terms, vocab, asked, block), chunks, queries, k)
    assert rounded(listed) == rounded(dense)


def test_runs_that_cannot_reach_the_result_are_not_read(corpus):
    chunks, queries, terms, vocab = corpus
    asked = postings.query_terms(queries, vocab)
    lists = postings.posting_blocks(terms, vocab, block=16)
    runs = {(r["query_id"], r["run"]): r["turn"] for r in postings.runs_to_read(asked, lists, 6, 0.7).collect()}
    read = [run for (query, run), turn in runs.items() if query == 10 and turn]
    assert sum(q == 10 for q, _ in runs) == 57 and {0, 25} <= set(read) and len(read) <= 6


def test_tokens_lose_other_characters(spark):
    from pyspark.sql import functions as F

    from leafmill.functions.text import tokens_of

    df = spark.createDataFrame([("Don't día, a-b-c  İx end. two2 \t--\n",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(tokens_of(F.col("text"))).collect()] == [["dont", "abc", "end", "two2"], [], None]


def test_terms_that_lie_by_document_are_not_shuffled_again(spark, monkeypatch):
    rows = [(d, c, " ".join(f"w{(k * k + d) % (9 + c)}x" for k in range(20 + c)) + (" only" if c else "")) for d in (1, 2, 3) for c in range(6)]
    chunks = spark.createDataFrame([*rows, (1, 7, ""), (None, 0, "w1x w2x"), (2, 8, None)], "doc_id long, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "w1x"), (1, "none"), (2, "only"), (None, "w1x")], "doc_id long, term string")

    def found():
        terms = lexical.chunk_terms(chunks)
        vocab = lexical.vocab_topn(terms, chunks, 8)
        weights = lexical.tfidf_weights(terms, vocab, weigh=chunks)
        lists = postings.posting_blocks(terms, vocab, asked, 4, weigh=chunks).select("doc_id", "term", "run", F.round("top", 9), F.array_sort(F.transform("entries", lambda e: F.struct(e["chunk_id"], F.round(e["weight"], 9)))))
        vectors = lexical.tfidf_vectors(chunks, 8).select("doc_id", "chunk_id", "text", F.transform("embedding", lambda v: F.round(v, 9)))
        return weights, [sorted(map(str, df.collect())) for df in (terms, vocab, weights.withColumn("weight", F.round("weight", 9)), lists, vectors)]

    weights, together = found()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "term" in x]
    monkeypatch.setattr(lexical, "hot_keys", lambda *_: {1: 2})
    monkeypatch.setattr(postings, "hot_keys", lambda *_: {1: 2})
    monkeypatch.setattr(lexical, "DOC_CHUNKS", 2)
    _, apart = found()
    assert all(together) and together == apart
