"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing to target weights, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written and read again as
the docs of the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.bpe import decode_bpe, encode_bpe
from leafmill.llm.common import read_table, stage
from leafmill.llm.mixing import mix_sources, n_words
from leafmill.llm.near_dedup import near_duplicates
from leafmill.llm.quality import fit_quality, quality_rules
from leafmill.llm.substring_dedup import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules(docs, model, carry=tuple(docs.columns)).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; of repeated rows one.

    If several texts of a group have that doc_id, the one with the smallest hash stays. Groups whose smallest doc_id is
    the same keep a text each. Rows without words or without a doc_id are in no group and stay.
    """
    found = near_duplicates(docs).where("kept AND n_shingles > 0 AND doc_id IS NOT NULL")
    chosen = found.groupBy("group_id").agg(F.min("component_id").alias("chosen_id"), F.min("text_hash").alias("chosen_hash")).drop("group_id")
    hashed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), (n_words("text") > 0).alias("words"))
    grouped = hashed.where("words AND own_id IS NOT NULL").join(chosen, F.expr("own_id = chosen_id AND own_hash = chosen_hash"))
    repeat = F.row_number().over(Window.partitionBy("own_id", "own_hash").orderBy(F.xxhash64("row")))
    first = grouped.withColumn("repeat", repeat).where("repeat = 1")
    return first.select("row.*").unionByName(hashed.where("NOT words OR own_id IS NULL").select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a smaller document has as well go; `n_chars` follows the text."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cleaned = dedup_substrings(docs, carry=tuple(rest))
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col(f"row.`{c}`") for c in rest}
    return cleaned.select(*[columns[c].alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mix_sources(docs, carry=tuple(docs.columns)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded_sha256 of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_bpe(docs, ranks, public_tokenizers.PATTERN)
    decoded = decode_bpe(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: SQL can't express the trained model, the confirmed components or the merges; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
