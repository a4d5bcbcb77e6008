"""Packing pages into retrieval chunks, and cutting long texts into overlapping parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.blocks import _BLK, NO_ANCHOR, block_anchors, block_of, entry_anchors
from leafmill.functions.text import PAGE_JOINER, is_blank, let, trim_ws
from leafmill.session import stage_table

# Fixed values.
CHUNK_CHARS = 4800
PART_CHARS = 60_000
PART_OVERLAP = 1_500
MAX_PARTS = 12
LONG_TEXT_CHARS = 80_000
PART_TAIL = 2_000
PART_BACKOFF = 1_500
PART_BREAKS = ("\n\n", ". ", "\n", " ")
PART_TRUNCATED = "\n\n[…document continues; truncated for length…]"

PAGES_PER_BLOCK = 4096
#: characters of parts that leave a task at once
PARTS_BYTES = 8 << 20


def piece_starts(page: Column, paragraphs: Column, max_chars: int) -> Column:
    """Where the sub-chunks of a page begin, as places in its paragraphs (from 0); worked out on lengths only."""
    again = F.length(page.cast("string")) + len("[Page  continued]\n")

    def step(acc: Column, para: Column) -> Column:
        full = (acc["cur"] + F.length(para) > max_chars) & (acc["cur"] > 20)
        return F.struct(
            (F.when(full, again).otherwise(acc["cur"]) + F.length(para) + len(PAGE_JOINER)).alias("cur"),
            (acc["at"] + 1).alias("at"),
            F.when(full, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
        )

    first = F.length(page.cast("string")) + len("[Page ]\n")
    empty = F.struct(first.alias("cur"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))
    return F.aggregate(paragraphs, empty, step, lambda acc: acc["starts"])


def split_large_page(page: Column, text: Column, max_chars: int) -> Column:
    """Sub-chunks of one page cut at paragraph breaks; a paragraph over the limit stays whole."""
    start = F.concat(F.lit("[Page "), page.cast("string"), F.lit("]\n"))
    again = F.concat(F.lit("[Page "), page.cast("string"), F.lit(" continued]\n"))

    def cut(paragraphs: Column, starts: Column) -> Column:
        def piece(at: Column, k: Column) -> Column:
            to = F.coalesce(F.get(starts, k + 1), F.size(paragraphs))
            body = F.array_join(F.slice(paragraphs, at + 1, to - at), PAGE_JOINER)
            return trim_ws(F.concat(F.when(k == 0, start).otherwise(again), body))

        return F.transform(starts, piece)

    return let(F.split(text, "\n{2,}"), lambda paragraphs: let(piece_starts(page, paragraphs, max_chars), lambda starts: cut(paragraphs, starts)))


def _page_blocks(pages: DataFrame, max_chars: int) -> DataFrame:
    """Numeric view of the pages: one row per (doc_id, block of pages) with sorted widths; no text is shuffled."""
    header = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"))
    width = F.length(header) + F.length("text")
    large = width > max_chars
    pieces = F.when(large, F.size(piece_starts(F.col("page"), F.split("text", "\n{2,}"), max_chars))).otherwise(F.lit(1))
    sizes = pages.select("doc_id", "page", width.alias("w"), pieces.alias("n"), large.alias("hard"))
    rows = sizes.groupBy("doc_id", block_of("page", PAGES_PER_BLOCK).alias(_BLK)).agg(
        F.sort_array(F.collect_list(F.struct("page", "w", "n", "hard"))).alias("r")
    )

    @F.pandas_udf("struct<a:array<double>,e:array<double>>")
    def coords(w: pd.Series) -> pd.DataFrame:
        ends = [np.cumsum(np.asarray(x, dtype=float) + len(PAGE_JOINER)) for x in w]
        starts = [e - (np.asarray(x, dtype=float) + len(PAGE_JOINER)) for e, x in zip(ends, w)]
        return pd.DataFrame({"a": starts, "e": ends})

    return (
        rows.withColumn("c", coords(F.col("r.w")))
        .select(
            "doc_id", _BLK, "r",
            F.col("c.a").alias("a"), F.col("c.e").alias("e"), F.col("r.hard").alias("hard"),
            F.element_at("c.e", -1).alias("span"),
        )
    )


def _assign_chunks(pages: DataFrame, max_chars: int) -> DataFrame:
    """(doc_id, block, page -> first chunk id, whether the chunk may span blocks)."""
    limit = float(max_chars + 2 * len(PAGE_JOINER))
    blocks = stage_table(_page_blocks(pages, max_chars))
    entries = entry_anchors(blocks, ["doc_id"], limit)

    @F.pandas_udf("struct<offset:array<int>,total:int>")
    def offsets(a: pd.Series, e: pd.Series, hard: pd.Series, n: pd.Series, entry: pd.Series) -> pd.DataFrame:
        out, totals = [], []
        for x, y, h, m, t in zip(a, e, hard, n, entry):
            start = np.asarray(x, dtype=float)
            anchors = block_anchors(start, np.asarray(y, dtype=float), np.asarray(h, dtype=bool), limit, t)
            opens = anchors == start
            produced = np.where(opens, np.asarray(m), 0)
            ends = np.cumsum(produced)
            firsts = np.maximum.accumulate(np.where(opens, ends - produced, -1))
            out.append(firsts.astype("int32"))
            totals.append(int(ends[-1]))
        return pd.DataFrame({"offset": out, "total": totals})

    entry = F.coalesce(F.col("entry"), F.lit(NO_ANCHOR))
    placed = blocks.join(entries, ["doc_id", _BLK], "left").select(
        "doc_id", _BLK, "r", offsets("a", "e", "hard", F.col("r.n"), entry).alias("o")
    )
    per_doc = Window.partitionBy("doc_id").orderBy(_BLK)
    base = F.coalesce(F.sum("o.total").over(per_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    last = F.lead(F.lit(1)).over(per_doc).isNull()
    numbered = placed.select("doc_id", _BLK, "r", "o", base.alias("base"), last.alias("last_block"))
    tail = F.element_at("o.offset", -1)
    spans = lambda off: (off == -1) | (~F.col("last_block") & (off == tail))
    entries_by_page = F.map_from_arrays(
        F.col("r.page"),
        F.transform(F.col("o.offset"), lambda off: F.struct((off + F.col("base")).alias("chunk"), spans(off).alias("open"))),
    )
    return numbered.select("doc_id", _BLK, entries_by_page.alias("plan"))


def chunk_pages(pages: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Greedy packing of pages into chunks (doc_id, chunk_id, text, pages), each page led by its `[Page N]` anchor.

    Where the chunks begin is worked out on page lengths only, block by block. Page text is then shuffled once, on
    (doc_id, block of pages); only chunks that may span two blocks are grouped a second time.
    """
    inked = pages.select("doc_id", "page", "text").filter(~is_blank(F.col("text")))
    plan = _assign_chunks(inked, max_chars)
    page, text = F.col("page"), F.col("text")
    block_text = F.concat(F.lit("[Page "), page.cast("string"), F.lit("]\n"), text)
    large = F.length(block_text) > max_chars
    texts = F.when(large, split_large_page(page, text, max_chars)).otherwise(F.array(block_text))
    pieces = (
        inked.withColumn(_BLK, block_of("page", PAGES_PER_BLOCK))
        .join(plan, ["doc_id", _BLK])
        .select("doc_id", _BLK, "page", F.element_at("plan", F.col("page")).alias("p"), texts.alias("texts"))
        .select("doc_id", _BLK, "page", F.col("p.chunk").alias("chunk"), F.col("p.open").alias("open"), F.posexplode("texts").alias("k", "piece"))
        .select("doc_id", _BLK, "page", (F.col("chunk") + F.col("k")).alias("chunk_id"), "open", "piece")
    )
    grouped = pieces.groupBy("doc_id", _BLK, "chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("page", "piece"))).alias("parts"), F.max("open").alias("open")
    )
    closed = grouped.filter(~F.col("open")).select("doc_id", "chunk_id", "parts")
    spanning = (
        grouped.filter("open")
        .groupBy("doc_id", "chunk_id")
        .agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"))
    )
    return closed.unionByName(spanning).select(
        "doc_id",
        "chunk_id",
        trim_ws(F.array_join(F.col("parts.piece"), PAGE_JOINER)).alias("text"),
        F.col("parts.page").alias("pages"),
    )


def part_cuts(text: str, size: int, overlap: int, max_parts: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of the overlapping parts of a text.

    Only the last `PART_TAIL` characters in front of a cut are looked at, so the time grows with the length of the text.
    """
    n, at, count = len(text), 0, 0
    while at >= 0 and (max_parts is None or count < max_parts):
        end = min(at + size, n)
        if end < n:
            tail = end - PART_TAIL
            back = max(text.rfind(mark, tail, end) for mark in PART_BREAKS) - tail
            if back > 0 and PART_TAIL - back < PART_BACKOFF:
                end = tail + back
        yield at, end
        at, count = (-1 if end >= n else max(end - overlap, at + 1)), count + 1


def chunk_overlap(
    docs: DataFrame, size: int = PART_CHARS, overlap: int = PART_OVERLAP, max_parts: int | None = None
) -> DataFrame:
    """Overlapping character parts (doc_id, chunk_no, text) that back off to the right-most break near their end.

    All of a document is cut unless `max_parts` (suggested: MAX_PARTS) is given; then the last part takes the rest, or a
    marker where that is longer than a part. A text of one part stays in the JVM; a longer one is cut in one pass over it,
    and its parts leave in batches of about `PARTS_BYTES`.
    """
    if size < PART_TAIL:
        raise ValueError(f"size must be at least {PART_TAIL}")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("chunk_no", T.IntegerType()), T.StructField("text", T.StringType())])

    def parts_of(text: str) -> Iterator[str]:
        for no, (start, end) in enumerate(part_cuts(text, size, overlap, max_parts)):
            part = text[start:end]
            if no + 1 == max_parts and end < len(text):
                rest = text[max(end - overlap, start + 1) :]
                part += "" if rest == part else PART_TRUNCATED if len(rest) > size else PAGE_JOINER + rest
            yield part

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row in range(batch.num_rows):
                first, held, chars = 0, [], 0
                for part in parts_of(batch.column("text")[row].as_py()):
                    held.append(part)
                    chars += len(part)
                    if chars >= PARTS_BYTES:
                        yield placed(ids[row], first, held)
                        first, held, chars = first + len(held), [], 0
                if held:
                    yield placed(ids[row], first, held)

    def placed(key: pa.Scalar, first: int, parts: list[str]) -> pa.RecordBatch:
        numbers = pa.array(range(first, first + len(parts)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.repeat(key, len(parts)), numbers, pa.array(parts, pa.string())], ["doc_id", "chunk_no", "text"])

    one = F.coalesce(F.length("text"), F.lit(0)) <= size
    short = docs.filter(one).select("doc_id", F.lit(0).alias("chunk_no"), F.coalesce("text", F.lit("")).alias("text"))
    return short.unionByName(docs.filter(~one).select("doc_id", "text").mapInArrow(cut, schema))


def map_reduce_docs(
    docs: DataFrame,
    map_fn: Callable[[str, int], str],
    reduce_fn: Callable[[list[str]], str],
    parse_fn: Callable[[str, int], str] | None = None,
    threshold: int = LONG_TEXT_CHARS,
    size: int = PART_CHARS,
    overlap: int = PART_OVERLAP,
    max_parts: int | None = None,
) -> DataFrame:
    """User map and reduce functions over the parts of each document.

    A short document runs `map_fn` once. A long one is cut, each part is mapped on its own (a failing part is dropped),
    and `reduce_fn` gets the surviving parts in order; a document fails only if all its parts fail. The parts of
    one document, which is one cell, are regrouped together.
    """
    is_long = F.coalesce(F.length("text"), F.lit(0)) > threshold
    whole = docs.filter(~is_long).select(
        "doc_id", F.lit(0).alias("chunk_no"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("chunked")
    )
    parts = chunk_overlap(docs.filter(is_long), size, overlap, max_parts).withColumn("chunked", F.lit(True))
    todo = whole.unionByName(parts)
    schema = f"{_ddl(todo, 'doc_id')}, chunk_no int, chunked boolean, content string, part string, error string"

    def run_map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, part, error = [], [], []
            for text, no in zip(batch["text"], batch["chunk_no"]):
                try:
                    result = map_fn(text, int(no))
                    content.append(result)
                    part.append(parse_fn(result, int(no)) if parse_fn else result)
                    error.append(None)
                except Exception as exc:  # a failed part is data here, not a failed job
                    content.append(None)
                    part.append(None)
                    error.append(str(exc) or type(exc).__name__)
            yield batch[["doc_id", "chunk_no", "chunked"]].assign(content=content, part=part, error=error)

    mapped = todo.mapInPandas(run_map, schema)
    grouped = mapped.groupBy("doc_id").agg(
        F.max("chunked").alias("chunked"),
        F.count(F.lit(1)).cast("int").alias("chunk_count"),
        F.array_sort(
            F.filter(F.collect_list(F.struct("chunk_no", "content", "part", "error")), lambda r: r["error"].isNull())
        ).alias("good"),
        F.min_by("error", "chunk_no").alias("first_error"),
    )
    flat = grouped.select(
        "doc_id", "chunked", "chunk_count", F.col("good.content").alias("contents"), F.col("good.part").alias("parts"), "first_error"
    )

    def run_reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            merged = []
            for contents, chunked in zip(batch["contents"], batch["chunked"]):
                values = list(contents)
                merged.append(None if not values else reduce_fn(values) if chunked else values[0])
            yield batch.drop(columns=["contents"]).assign(content=merged)

    out_schema = f"{_ddl(todo, 'doc_id')}, chunked boolean, chunk_count int, parts array<string>, first_error string, content string"
    return flat.mapInPandas(run_reduce, out_schema).select(
        "doc_id", "content", "chunked", "chunk_count", "parts",
        F.when(F.size("parts") == 0, F.col("first_error")).alias("error"),
    )


def _ddl(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"
