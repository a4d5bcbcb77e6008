"""Cutting raw text into page rows, and page-level roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.blocks import block_join
from leafmill.functions.text import WS, nonempty

PAGE_CHARS = 2000
SCANNED_CHARS = 30


def paginate_fixed(docs: DataFrame, size: int = PAGE_CHARS, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Synthetic pages of exactly `size` characters, numbered from 1; an empty text still gives one page."""
    body = F.coalesce(F.col(text), F.lit(""))
    # one linear pass over the text; a substring per page would scan from the start every time
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    slices = F.when(F.length(body) > 0, cut).otherwise(F.array(F.lit("")))
    return docs.select(F.col(doc), F.posexplode(slices).alias("pos", "text")).select(
        doc,
        (F.col("pos") + 1).alias("page"),
        "text",
        F.lit(False).alias("was_ocr"),
        F.length("text").alias("char_count"),
    )


def scan_profile(pages: DataFrame, threshold: int = SCANNED_CHARS) -> DataFrame:
    """One row per document: pages, pages whose OCR succeeded, and how many would need OCR."""
    inked = F.length(F.regexp_replace("text", WS + "+", ""))
    return (
        pages.select("doc_id", "was_ocr", (inked < threshold).alias("sparse"))
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("total_pages"),
            F.count_if("was_ocr").alias("scanned_pages"),
            F.count_if("sparse").alias("ocr_needed"),
        )
        .withColumn("is_fully_scanned", F.col("scanned_pages") == F.col("total_pages"))
        .withColumn("has_scanned_content", F.col("scanned_pages") > 0)
    )


LABEL_SLOTS = ("header_left", "header_center", "header_right", "footer_left", "footer_center", "footer_right")
DEFAULT_TEMPLATES = {"footer_center": "{page} / {total}"}


def page_labels(
    pages: DataFrame,
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    today: str = "",
    start_page: int | None = None,
    end_page: int | None = None,
) -> DataFrame:
    """Text of every header and footer slot, per page in the wanted range.

    `pages` needs (doc_id, page); `docs` needs (doc_id, title). `today` is already formatted as dd/mm/yyyy.
    """
    chosen = {slot: (templates or {}).get(slot) or DEFAULT_TEMPLATES.get(slot, "") for slot in LABEL_SLOTS}
    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    info = totals.join(docs.select("doc_id", nonempty(F.col("title"), F.lit("")).alias("title")), "doc_id", "left")
    slots = F.array(
        *[F.struct(F.lit(s).alias("slot"), F.lit(t).alias("template")) for s, t in chosen.items() if t]
    )
    first = max(1, start_page or 1)
    wanted = pages.select("doc_id", "page").filter(F.col("page") >= first)
    joined = block_join(wanted, info.withColumn("last", F.col("total")), ["doc_id"], "page", "last").filter(
        F.col("page") <= F.least(F.lit(end_page), F.col("total"))
    )
    text = F.col("s.template")
    for mark, value in (
        (r"(?i)\{page\}", F.col("page").cast("string")),
        (r"(?i)\{total\}", F.col("total").cast("string")),
        (r"(?i)\{date\}", F.lit(today)),
        (r"(?i)\{title\}", F.regexp_replace(F.coalesce("title", F.lit("")), r"([\\$])", r"\\$1")),
    ):
        text = F.regexp_replace(text, F.lit(mark), value)
    return joined.withColumn("s", F.explode(slots)).select("doc_id", "page", F.col("s.slot").alias("slot"), text.alias("text"))
