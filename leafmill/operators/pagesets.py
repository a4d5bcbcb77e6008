"""Set operations on page tables. Pages of a document are numbered from 1; numbers may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.blocks import block_join, block_of, keep_first, number_rows, prefix_sums, spread_join
from leafmill.functions.text import is_blank, trim_ws

# Fixed values.
MAX_INPUT_BYTES = 100 * 1024 * 1024


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


def page_extents(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): the last page number of every document."""
    return pages.groupBy("doc_id").agg(F.max("page").alias("pages"))


def renumber(pages: DataFrame) -> DataFrame:
    return number_rows(pages.withColumnRenamed("page", "_old"), ["doc_id"], ["_old"], block_of("_old"), "page").drop("_old")


def concat_docs(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Merge documents: `order` is (out_id, pos, doc_id); pages are numbered through (out_id, page, …).

    A document takes as many numbers as its last page has, so gaps inside it stay gaps.
    """
    sized = order.join(page_extents(pages), "doc_id")
    offsets = prefix_sums(sized, ["out_id"], ["pos"], {"offset": F.col("pages")}, block_of("pos")).select(
        "out_id", "doc_id", "offset", "pages"
    )
    return (
        block_join(pages, offsets, ["doc_id"], "page", "pages")
        .withColumn("page", (F.col("page") + F.col("offset")).cast("int"))
        .drop("offset")
    )


def split_docs(pages: DataFrame, ranges: DataFrame, tail: bool = False) -> DataFrame:
    """(doc_id, part, page, source_page, …): `ranges` is (doc_id, part, pages); `tail` adds a part after the last."""
    wanted = ranges.select("doc_id", "part", F.posexplode("pages").alias("k", "source_page"))
    src = pages.withColumnRenamed("page", "source_page")
    parts = src.join(wanted, ["doc_id", "source_page"]).withColumn("page", F.col("k") + 1).drop("k")
    if not tail:
        return parts
    last = (
        ranges.groupBy("doc_id")
        .agg((F.max("part") + 1).alias("part"), F.max(F.array_max("pages")).alias("last"))
        .join(page_extents(pages), "doc_id")
    )
    rest = (
        block_join(src, last, ["doc_id"], "source_page", "pages")
        .filter(F.col("source_page") > F.col("last"))
        .withColumn("page", (F.col("source_page") - F.col("last")).cast("int"))
        .drop("last")
    )
    return parts.unionByName(rest)


def select_pages(pages: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected pages in the listed order, unknown pages): `selection` is (doc_id, pos, page), pos from 1."""
    src = pages.withColumnRenamed("page", "source_page")
    listed = selection.select("doc_id", F.col("pos").cast("int").alias("page"), F.col("page").alias("source_page"))
    unknown = listed.join(src.select("doc_id", "source_page"), ["doc_id", "source_page"], "left_anti").select(
        "doc_id", "source_page", F.lit("no such page").alias("error")
    )
    return src.join(listed, ["doc_id", "source_page"]), unknown


def remove_pages(pages: DataFrame, removed: DataFrame) -> DataFrame:
    return renumber(pages.join(removed.select("doc_id", "page"), ["doc_id", "page"], "left_anti"))


def reorder_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """`orders` is (doc_id, order array of page numbers)."""
    selection = orders.select("doc_id", F.posexplode("order").alias("k", "page")).select("doc_id", (F.col("k") + 1).alias("pos"), "page")
    return select_pages(pages, selection)[0]


def reverse_pages(pages: DataFrame) -> DataFrame:
    counts = page_counts(pages).withColumn("last", F.col("pages"))
    return (
        block_join(pages, counts, ["doc_id"], "page", "last")
        .withColumn("page", (F.col("pages") - F.col("page") + 1).cast("int"))
        .drop("pages")
    )


def duplicate_pages(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """A listed page comes twice, right after itself."""
    marks = listed.select("doc_id", "page").distinct().withColumn("_twice", F.lit(1))
    marked = pages.join(marks, ["doc_id", "page"], "left").fillna(0, ["_twice"])
    shifted = prefix_sums(marked, ["doc_id"], ["page"], {"_before": F.col("_twice")}, block_of("page"))
    return (
        shifted.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_twice"))))
        .withColumn("page", (F.col("page") + F.col("_before") + F.col("_copy")).cast("int"))
        .drop("_twice", "_before", "_copy")
    )


def page_selector(selectors: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, page) named by selectors such as 'all', 'first', 'last' or '1-3,5'; bad tokens are ignored."""
    total = F.col("pages").cast("int")

    def lead(s: Column) -> Column:
        """The number a text starts with; longer ones than any page count are as good as the largest."""
        digits = F.regexp_extract(s, r"^\s*\+?0*(\d+)", 1)
        return F.when(F.length(digits) > 9, F.lit(999_999_999)).otherwise(F.nullif(digits, F.lit("")).cast("int"))

    def bounds(token: Column) -> Column:
        t = trim_ws(token)
        dashed = F.contains(t, F.lit("-"))
        ends = F.split(t, "-")
        lo = F.when(dashed, F.greatest(F.lit(1), lead(ends[0]))).otherwise(lead(t))
        hi = F.when(dashed, F.least(total, lead(F.get(ends, F.lit(1))))).otherwise(lead(t))
        missing = F.when(dashed, lead(ends[0]).isNull() | lead(F.get(ends, F.lit(1))).isNull()).otherwise(False)
        return F.struct(F.when(~missing, lo).alias("lo"), F.when(~missing, hi).alias("hi"))

    spans = (
        F.when(F.col("selector") == "all", F.array(F.struct(F.lit(1).alias("lo"), total.alias("hi"))))
        .when(F.col("selector") == "first", F.array(F.struct(F.lit(1).alias("lo"), F.lit(1).alias("hi"))))
        .when(F.col("selector") == "last", F.array(F.struct(total.alias("lo"), total.alias("hi"))))
        .otherwise(F.transform(F.split("selector", ","), bounds))
    )
    named = selectors.join(counts, "doc_id").select("doc_id", "pages", F.explode(spans).alias("s"))
    valid = named.filter((F.col("s.lo") >= 1) & (F.col("s.lo") <= F.col("s.hi")) & (F.col("s.hi") <= total))
    return valid.select("doc_id", F.explode(F.sequence("s.lo", "s.hi")).alias("page")).distinct()


def page_fingerprint(keys: list[str], content: str = "text") -> Column:
    """Hash of the page's geometry and content; a page without readable content is unlike any other."""
    body = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col(content))
    return F.when(F.col(content).isNull(), F.concat(F.lit("page:"), F.col("page").cast("string"))).otherwise(F.md5(body))


def dedupe_pages(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First page of every fingerprint per document, renumbered."""
    marked = pages.withColumn("fingerprint", page_fingerprint(keys or []))
    return renumber(keep_first(marked, ["doc_id", "fingerprint"], "page").drop("fingerprint"))


def dedupe_corpus(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First page of every fingerprint over all documents; page numbers stay."""
    marked = pages.withColumn("fingerprint", page_fingerprint(keys or []))
    firsts = marked.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "page")).alias("f")).select("f.doc_id", "f.page")
    return pages.join(firsts, ["doc_id", "page"], "left_semi")


def drop_blank_pages(pages: DataFrame, objects: str = "n_objects") -> DataFrame:
    """Pages with text or embedded objects; a document of blanks keeps its first page."""
    inked = ~is_blank(F.col("text")) | (F.coalesce(F.col(objects), F.lit(0)) > 0)
    blank_docs = (
        pages.groupBy("doc_id")
        .agg(F.max(inked).alias("any"), F.min("page").alias("page"))
        .filter(~F.col("any"))
        .select("doc_id", "page")
    )
    kept = pages.filter(inked).unionByName(pages.join(blank_docs, ["doc_id", "page"], "left_semi"))
    return renumber(kept)


def content_cache(inputs: DataFrame, cache: DataFrame, max_bytes: int | None = MAX_INPUT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, misses, rejects): `inputs` is (id, content), `cache` is (hash, result, size).

    Every distinct content is a miss at most once; an empty cached result counts as absent, and of several for one hash
    the largest stands. Inputs that are empty (or null) or larger than `max_bytes` are rejects (id, bytes, reason).
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = F.when(size == 0, "empty")
    if max_bytes is not None:
        reason = reason.when(size > max_bytes, "too large")
    sized = inputs.withColumn("reason", reason)
    rejects = sized.filter(F.col("reason").isNotNull()).select("id", size.alias("bytes"), "reason")
    hashed = sized.filter(F.col("reason").isNull()).select("id", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    usable = cache.filter(F.col("size") > 0).groupBy("hash").agg(F.max_by("result", F.struct("size", "result")).alias("result"))
    distinct = hashed.groupBy("hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("inputs"))
    known = usable.join(distinct, "hash", "left_semi")
    hits = spread_join(hashed, known, ["hash"], F.col("id"))
    misses = distinct.join(usable, "hash", "left_anti")
    return hits, misses, rejects
