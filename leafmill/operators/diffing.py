"""Comparing two versions of a corpus page by page, interleaving them, and merging reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import place_of, trim_ws, words_of

# Fixed values.
MAX_WORDS = 100


def page_diffs(pages_a: DataFrame, pages_b: DataFrame, max_segments: int | None = None) -> DataFrame:
    """(doc_id, page, status, removed, added): sentence or line segments found on one side only, repeats kept.

    All of them, or the first `max_segments` (suggested: 20) of each side.
    """
    side = lambda df, c: df.select("doc_id", "page", trim_ws(F.col("text")).alias(c))
    both = side(pages_a, "a").join(side(pages_b, "b"), ["doc_id", "page"], "full_outer").fillna("", ["a", "b"])
    segments = lambda c: F.filter(F.transform(F.split(c, r"[.\n]+"), trim_ws), lambda s: F.length(s) > 0)
    cut = both.withColumn("sa", segments(F.col("a"))).withColumn("sb", segments(F.col("b")))
    same = F.col("a") == F.col("b")
    missing = lambda x, y: F.filter(x, lambda s: ~F.array_contains(F.col(y), s))
    only = missing if max_segments is None else lambda x, y: F.slice(missing(x, y), 1, max_segments)
    empty = F.array().cast("array<string>")
    return cut.select(
        "doc_id",
        "page",
        F.when(same, "identical").otherwise("changed").alias("status"),
        F.when(same, empty).otherwise(only("sa", "sb")).alias("removed"),
        F.when(same, empty).otherwise(only("sb", "sa")).alias("added"),
    )


def _word_table(pages_a: DataFrame, pages_b: DataFrame) -> DataFrame:
    """(doc_id, word, in_a, in_b, first_a, first_b): one map-side combined aggregate over both versions."""
    side = lambda df, v: df.select(
        "doc_id", F.lit(v).alias("v"), "page", F.posexplode(words_of(trim_ws(F.col("text")))).alias("k", "word")
    )
    words = side(pages_a, "a").unionByName(side(pages_b, "b"))
    whole = words.schema["page"].dataType == T.IntegerType()
    at = place_of(F.col("page"), F.col("k")) if whole else F.struct("page", "k")
    return words.groupBy("doc_id", "word").agg(
        F.count_if(F.col("v") == "a").alias("in_a"),
        F.count_if(F.col("v") == "b").alias("in_b"),
        F.min(F.when(F.col("v") == "a", at)).alias("first_a"),
        F.min(F.when(F.col("v") == "b", at)).alias("first_b"),
    )


def diff_summary(pages_a: DataFrame, pages_b: DataFrame) -> DataFrame:
    """One row per document: page, word and character counts of both versions and their word-set similarity."""
    sizes = lambda df, p: df.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias(f"{p}_pages"),
        (F.sum(F.length(trim_ws(F.col("text")))) + F.count(F.lit(1)) - 1).alias(f"{p}_chars"),
    )
    a, b = F.col("in_a") > 0, F.col("in_b") > 0
    words = _word_table(pages_a, pages_b).groupBy("doc_id").agg(
        F.sum("in_a").alias("a_words"),
        F.sum("in_b").alias("b_words"),
        F.count_if(a & b).alias("common_words"),
        F.count_if(a).alias("_sa"),
        F.count_if(b).alias("_sb"),
    )
    joined = sizes(pages_a, "a").join(sizes(pages_b, "b"), "doc_id", "full_outer").join(words, "doc_id", "left").fillna(0)
    most = F.greatest("_sa", "_sb")
    return joined.withColumn(
        "similarity", F.when(most == 0, 100.0).otherwise(F.col("common_words") / most * 100)
    ).drop("_sa", "_sb")


def word_diffs(pages_a: DataFrame, pages_b: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, side, rank, word): words of one version only, in the order they are first seen.

    All of them, or the first `cap` (suggested: MAX_WORDS) of each side.
    """
    words = _word_table(pages_a, pages_b)
    single = words.filter((F.col("in_a") == 0) | (F.col("in_b") == 0)).select(
        "doc_id",
        F.when(F.col("in_b") == 0, "only_a").otherwise("only_b").alias("side"),
        F.coalesce("first_a", "first_b").alias("first"),
        "word",
    )
    rank = F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("first"))
    ranked = single.withColumn("rank", rank).select("doc_id", "side", "rank", "word")
    return ranked if cap is None else ranked.filter(F.col("rank") <= cap)


def interleave_pages(pages_a: DataFrame, pages_b: DataFrame) -> DataFrame:
    """(doc_id, position, side, page, text, filler): 1a, 1b, 2a, 2b, …; a missing side gives a blank filler."""
    a = pages_a.select("doc_id", "page", F.col("text").alias("a"), F.lit(True).alias("has_a"))
    b = pages_b.select("doc_id", "page", F.col("text").alias("b"), F.lit(True).alias("has_b"))
    side = lambda k, name: F.struct(
        F.lit(k).alias("k"), F.lit(name).alias("side"), F.coalesce(name, F.lit("")).alias("text"), F.col(f"has_{name}").isNull().alias("filler")
    )
    return (
        a.join(b, ["doc_id", "page"], "full_outer")
        .select("doc_id", "page", F.explode(F.array(side(1, "a"), side(2, "b"))).alias("s"))
        .select("doc_id", (2 * (F.col("page") - 1) + F.col("s.k")).alias("position"), F.col("s.side").alias("side"), "page", F.col("s.text").alias("text"), F.col("s.filler").alias("filler"))
    )


def merge_review(
    base_pages: DataFrame, base_ann: DataFrame, review_pages: DataFrame, review_ann: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(pages, annotations): the base with the reviewer's annotations.

    Annotations are copied onto pages both have. Extra reviewer pages are appended and bring their own along, so a
    review annotation is kept whenever its page exists in the review.
    """
    extra = review_pages.join(base_pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    pages = base_pages.withColumn("origin", F.lit("base")).unionByName(extra.withColumn("origin", F.lit("review")))
    copied = review_ann.join(review_pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    annotations = base_ann.withColumn("origin", F.lit("base")).unionByName(copied.withColumn("origin", F.lit("review")))
    return pages, annotations
