"""The pipeline's stages, each on its own input, against what they are defined to keep."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from leafmill.llm.common import read_table, stage

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = read_table(spark, SF, "documents").withColumns({"row": F.lit(1), "text_hash": F.lit("x")})
    steps = [stage(docs)]
    for _, step in pipeline.STAGES[:-1]:
        steps.append(stage(step(spark, steps[-1], SF)))
        assert steps[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    quality = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    assert all(quality.get(i, 1) == 1 for i in rows[1])  # what is labelled bad goes
    texts = Counter(r["text"] for r in rows[2].values())
    assert set(texts.values()) == {1} and rows[2].keys() < rows[1].keys()
    assert {r["text"] for r in rows[1].values()} >= set(texts)
    assert rows[3].keys() == rows[2].keys() and all(r["n_chars"] == len(r["text"]) for r in rows[3].values())
    taken = Counter(r["doc_id"] for r in steps[4].collect())
    assert max(taken.values()) <= 3 and taken.keys() <= rows[3].keys()
    last = pipeline.byte_bpe(spark, steps[4], SF).collect()
    assert Counter(r["doc_id"] for r in last) == taken and all(4 * r["n_tokens"] == len(r["ids"]) for r in last)


def test_repeated_rows_and_rows_in_no_group(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text), (1, text), (2, text + " end"), (None, text), (3, None), (3, "")]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, text), (None, text), (3, None), (3, "")])


def test_unlinked_texts_under_one_id_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcd"]
    rows = [(5, t) for t in texts] + [(9, texts[0] + " end"), (9, texts[1] + " end"), (9, texts[2])]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, kept)) == [(5, t) for t in texts]


def test_a_carried_text_travels_once(spark):
    from leafmill.llm.quality import quality_rules

    docs = spark.createDataFrame([(1, "word " * 60, "s"), (2, None, None), (None, "a b", "t")], "doc_id long, text string, source string")
    plain, carried = quality_rules(docs, None), quality_rules(docs, None, carry=("doc_id", "text", "source"))
    assert [r[:-1] for r in map(tuple, carried.collect())] == list(map(tuple, plain.collect()))
    assert [tuple(r["row"]) for r in carried.collect()] == list(map(tuple, docs.collect()))
    sent = carried._jdf.queryExecution().analyzed().children().head().output().mkString(",")
    assert "text#" not in sent and "row#" in sent
