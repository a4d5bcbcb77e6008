"""Cleaning of page text: hyphenation, page numbers, white space, and furniture repeated over a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.blocks import block_join, spread_join
from leafmill.functions.text import WS, clip, lines_of, squeeze, trim_ws
from leafmill.session import stage_table

# Fixed values.
MAX_DOCUMENT_CHARS = 500_000
MAX_PROMPT_CHARS = 100_000
MAX_QUESTION_CHARS = 2_000
MIN_PLAIN_CHARS = 40
TRUNCATION_MARK = "\n\n[Document truncated — exceeded maximum processing length]"
NUMBER_LINE = f"(?m)^{WS}*[-–—]?{WS}*\\d{{1,4}}{WS}*[-–—]?{WS}*$"
ANCHORS = (r"\[Page \d+\]", r"\[Slide \d+\]", r"\[Sheet [^\]]+\]")


def clean_text(c: Column) -> Column:
    joined = F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")
    spaced = F.regexp_replace(joined, r"\n{3,}", "\n\n")
    unnumbered = F.regexp_replace(spaced, NUMBER_LINE, "")
    tidy = F.transform(lines_of(unnumbered), lambda line: trim_ws(F.regexp_replace(line, WS + "{2,}", " ")))
    return trim_ws(F.array_join(tidy, "\n"))


def clean_pages(pages: DataFrame, audit: bool = False) -> DataFrame:
    """Clean each page on its own; `audit` adds the character counts before and after."""
    out = pages.withColumn("_raw", F.col("text")).withColumn("text", clean_text(F.col("text")))
    if audit:
        out = out.withColumn("chars_before", F.length("_raw")).withColumn("chars_after", F.length("text"))
    return out.drop("_raw")


def repeated_lines(pages: DataFrame, ratio: float = 0.6, min_pages: int = 3, min_chars: int = 4) -> DataFrame:
    """(doc_id, furniture, last_page): trimmed lines found on at least max(min_pages, ceil(ratio * pages)) pages of their document.

    Counting is a map-side combined aggregate on (doc_id, line). A page adds each line once, so the lines that reach
    the ratio number at most (lines on one page) / ratio: the collected array is bounded by one page, not by the
    document.
    """
    page_lines = F.array_distinct(
        F.filter(F.transform(lines_of(F.col("text")), trim_ws), lambda line: F.length(line) >= min_chars)
    )
    counts = (
        pages.select("doc_id", F.explode(page_lines).alias("line"))
        .groupBy("doc_id", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    sizes = (
        pages.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("pages"), F.max("page").alias("last_page"))
        .filter(F.col("pages") >= min_pages)
    )
    return (
        spread_join(counts, sizes, ["doc_id"], F.col("line"), weigh=pages)
        .filter(F.col("n") >= F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * F.lit(ratio))))
        .groupBy("doc_id")
        .agg(F.collect_list("line").alias("furniture"), F.first("last_page").alias("last_page"))
    )


def drop_repeated_lines(pages: DataFrame, ratio: float = 0.6, min_pages: int = 3) -> DataFrame:
    """Remove the repeated lines inside each page row; page text is shuffled at most once and no page is lost.

    The lines are counted once, whoever reads the pages how often; `pages` is read for the count and for the result.
    """
    furniture = stage_table(repeated_lines(pages, ratio, min_pages))
    kept = F.filter(lines_of(F.col("text")), lambda line: ~F.array_contains(F.col("furniture"), trim_ws(line)))
    text = F.when(F.col("furniture").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return block_join(pages, furniture, ["doc_id"], "page", "last_page", "left").withColumn("text", text).drop("furniture")


def clean_corpus(pages: DataFrame, file_type: Column | None = None) -> DataFrame:
    """Both cleaning steps; plain-text documents (file_type 'txt') pass through untouched."""
    if file_type is None:
        return drop_repeated_lines(stage_table(clean_pages(pages)))
    marked = pages.withColumn("_plain", F.coalesce(file_type == "txt", F.lit(False)))
    rich = drop_repeated_lines(stage_table(clean_pages(marked.filter(~F.col("_plain")))))
    return rich.unionByName(marked.filter("_plain")).drop("_plain")


def truncate_text(c: Column, max_chars: int) -> Column:
    body = F.coalesce(c, F.lit(""))
    return F.when(F.length(body) <= max_chars, body).otherwise(F.concat(clip(body, max_chars), F.lit(TRUNCATION_MARK)))


def truncate_docs(docs: DataFrame, max_chars: int = MAX_DOCUMENT_CHARS) -> DataFrame:
    return docs.select(
        "*",
        (F.coalesce(F.length("text"), F.lit(0)) > max_chars).alias("was_truncated"),
        truncate_text(F.col("text"), max_chars).alias("truncated"),
    )


def truncation_report(docs: DataFrame, by: str, max_chars: int = MAX_DOCUMENT_CHARS) -> DataFrame:
    """Share of truncated documents per group."""
    cut = F.coalesce(F.length("text"), F.lit(0)) > max_chars
    return docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(cut).alias("truncated_docs"),
        F.round(F.avg(cut.cast("double")), 6).alias("truncated_share"),
    )


def input_limits(
    docs: DataFrame, text: str = "text", max_text: int = MAX_PROMPT_CHARS, question: str | None = None,
    max_question: int = MAX_QUESTION_CHARS,
) -> DataFrame:
    """Flag rows whose text or question is over its limit."""
    reason = F.when(F.length(text) > max_text, F.lit("text too long"))
    if question:
        reason = reason.when(F.length(question) > max_question, F.lit("question too long"))
    return docs.withColumn("reject_reason", reason)


def strip_anchors(c: Column) -> Column:
    for pattern in ANCHORS:
        c = F.regexp_replace(c, pattern, " ")
    return c


def sufficiency(docs: DataFrame, min_chars: int = MIN_PLAIN_CHARS) -> DataFrame:
    """Characters left once page, slide and sheet anchors are gone; under the minimum the document is insufficient."""
    plain = F.length(squeeze(strip_anchors(F.coalesce(F.col("text"), F.lit("")))))
    return docs.select("doc_id", plain.alias("plain_len")).withColumn("insufficient", F.col("plain_len") < min_chars)
