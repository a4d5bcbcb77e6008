"""Text structure: HTML to text, chapters and typed lines, paragraphs, blocks, table cells, slides, positioned lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.blocks import NO_ANCHOR, block_anchors, block_of, number_rows, point_segments, prefix_sums
from leafmill.functions.text import WS, WS_CHARS, clip, let, lines_of, squeeze, trim_ws
from leafmill.session import stage_table

# Fixed values.
MIN_CHAPTER_CHARS = 5
TITLE_CHARS = 100
SHORT_BLOCK_CHARS = 120
H3_BLOCK_CHARS = 60
READABLE_CHARS = 50
SLIDE_TITLE_CHARS = 80
LINE_TOLERANCE = 3.0
LINE_BAND = 5.0
#: items of a page that one task puts into lines
PAGE_ITEMS = 1 << 17
HEADING_CAPS = r"^([A-Z][A-Z0-9 \-:&()/.,]{2,80})$"
HEADING_TITLE = r"^(\d+\.)?\s*[A-Z][A-Za-z0-9]+(\s+[A-Z][A-Za-z0-9]+){0,6}\s*:?\s*$"
HEADING_ELEMENT = r"(?i)<h[1-3][^>]*>([\s\S]*?)</h[1-3]>"
UNREAD_ELEMENT = r"(?i)<(script|style)[^>]*>[\s\S]*?</\1>"
BLOCK_HEADING = r"(?i)<h([1-3])[^>]*>(.*?)</h\1>"
LINE_ENDS = ((r"(?i)</p>", "\n\n"), (r"(?i)<br\s*/?>|</li>", "\n"))
INLINE_MARKS = ((r"(?i)<li[^>]*>", "• "), (r"(?i)<(strong|b)[^>]*>(.*?)</(strong|b)>", "**$2**"), (r"(?i)<(em|i)[^>]*>(.*?)</(em|i)>", "_$2_"))
BLOCK_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
NAMED_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))


# ---- HTML -----------------------------------------------------------------------------------------------------------


def decode_numeric_entities(c: Column) -> Column:
    """`&#NNN;` to the character with that UTF-16 code."""
    code = lambda s: F.pmod(s.cast("bigint"), F.lit(65536))
    glyph = lambda s: F.decode(F.unhex(F.lpad(F.hex(code(s)), 4, "0")), "UTF-16BE")
    codes = F.regexp_extract_all(c, F.lit(r"&#(\d+);"), F.lit(1))
    parts = F.split(c, r"&#\d+;")
    woven = F.zip_with(parts, codes, lambda p, s: F.concat(p, F.coalesce(glyph(s), F.lit(""))))
    return F.when(F.contains(c, F.lit("&#")), F.array_join(woven, "")).otherwise(c)


def plain_html(c: Column) -> Column:
    """Text of an HTML fragment: no scripts, no tags, entities decoded one after the other, white space collapsed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), UNREAD_ELEMENT, "")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in NAMED_ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return squeeze(decode_numeric_entities(text))


def html_to_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    return pages.withColumn(out, plain_html(F.col(html)))


def html_chapters(parts: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Chapters as pages from parts (doc_id, pos, html): near-empty parts go, the rest are numbered from 1.

    Titles are whole, or their first `title_chars` (suggested: TITLE_CHARS) characters.
    """
    heading = F.regexp_extract(F.col("html"), HEADING_ELEMENT, 1)
    titled = F.rlike(F.col("html"), F.lit(HEADING_ELEMENT))
    read = parts.select(
        "doc_id", "pos", plain_html(F.col("html")).alias("text"),
        F.when(titled, plain_html(heading) if title_chars is None else clip(plain_html(heading), title_chars)).alias("title"),
    ).filter(F.length("text") >= MIN_CHAPTER_CHARS)
    return number_rows(read, ["doc_id"], ["pos"], block_of("pos"), "page").select(
        "doc_id",
        "page",
        "text",
        F.lit(False).alias("was_ocr"),
        F.length("text").alias("char_count"),
        F.coalesce("title", F.concat(F.lit("Chapter "), F.col("page").cast("string"))).alias("chapter_title"),
    )


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line_no, block_type, text): headings, list items and text lines of an HTML page.

    A page is cut at its headings into pieces; each piece gives (type, line) pairs, and only the first line of a heading
    has its type. Empty lines at the ends go and runs of them count as one. A null page gives no rows.
    """
    pieces = pages.select(key, F.regexp_replace(html, UNREAD_ELEMENT, "").alias("_body")).select(
        key, F.split("_body", BLOCK_HEADING).alias("_flows"), F.regexp_extract_all("_body", F.lit(BLOCK_HEADING), F.lit(0)).alias("_heads")
    )

    def typed(piece: Column, first: Column) -> Column:
        return F.transform(_marked_lines(piece), lambda line, k: F.struct(F.when(k == 0, first).otherwise("text").alias("kind"), line.alias("line")))

    def heading(h: Column) -> Column:
        return typed(F.regexp_extract(h, BLOCK_HEADING, 2), F.concat(F.lit("h"), F.regexp_extract(h, BLOCK_HEADING, 1)))

    # the last flow has no heading after it
    woven = F.zip_with(
        "_flows", "_heads", lambda flow, h: F.when(h.isNull(), typed(flow, F.lit("text"))).otherwise(F.concat(typed(flow, F.lit("text")), heading(h)))
    )
    empty = lambda r: (r["kind"] == "text") & (r["line"] == "")
    blank = lambda r: (r["kind"] == "text") & (trim_ws(r["line"]) == "")
    single = lambda rows: F.filter(rows, lambda r, k: (k == 0) | ~empty(r) | ~F.coalesce(empty(F.get(rows, k - 1)), F.lit(False)))
    inked = lambda rows: F.transform(rows, lambda r: ~blank(r))

    def trimmed(rows: Column) -> Column:
        return let(
            F.struct(F.array_position(inked(rows), True).alias("head"), F.array_position(F.reverse(inked(rows)), True).alias("tail")),
            lambda at: F.when(at["head"] == 0, F.slice(rows, 1, 1)).otherwise(
                F.slice(rows, at["head"].cast("int"), (F.size(rows) - at["head"] - at["tail"] + 2).cast("int"))
            ),
        )

    rows = let(F.flatten(woven), lambda all_rows: let(single(all_rows), trimmed))
    return pieces.select(key, F.posexplode(rows).alias("pos", "row")).select(
        key,
        (F.col("pos") + 1).alias("line_no"),
        F.when(blank(F.col("row")), "blank").otherwise(F.col("row.kind")).alias("block_type"),
        trim_ws(F.col("row.line")).alias("text"),
    )


def _marked_lines(piece: Column) -> Column:
    """Lines of a piece of HTML without tags; bold, emphasis and list items keep a mark in the text."""
    for pattern, mark in LINE_ENDS + INLINE_MARKS + ((r"<[^>]*>", ""),):
        piece = F.regexp_replace(piece, pattern, mark)
    for name, char in BLOCK_ENTITIES:
        piece = F.replace(piece, F.lit(name), F.lit(char))
    return lines_of(piece)


# ---- plain text -----------------------------------------------------------------------------------------------------


def block_type(c: Column) -> Column:
    open_end = ~F.rlike(c, F.lit("[.!?,;:]$"))
    short = F.length(c) < SHORT_BLOCK_CHARS
    return (
        F.when(short & (c == F.upper(c)) & (F.length(c) > 2) & open_end, "h2")
        .when(short & open_end & F.rlike(c, F.lit(f"(?i)^(chapter|section|part){WS}")), "h1")
        .when(short & open_end & (F.length(c) < H3_BLOCK_CHARS), "h3")
        .otherwise("p")
    )


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, type, content): blank-line separated blocks, headings guessed from their form."""
    blocks = F.filter(
        F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), rf"\n{WS}*\n"), squeeze), lambda b: F.length(b) > 0
    )
    return docs.select("doc_id", F.posexplode(blocks).alias("pos", "content")).select(
        "doc_id", (F.col("pos") + 1).alias("block_no"), block_type(F.col("content")).alias("type"), "content"
    )


def reflow_stats(docs: DataFrame) -> DataFrame:
    """One row per document: readable at all, word count, and blocks per type."""
    body = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.length(trim_ws(body)) > READABLE_CHARS).alias("has_text"),
        F.size(F.split(trim_ws(body), WS + "+")).alias("word_count"),
    )
    counts = text_blocks(docs).groupBy("doc_id").agg(
        *[F.count_if(F.col("type") == t).alias(f"{t}_blocks") for t in ("h1", "h2", "h3", "p")]
    )
    zero = {f"{t}_blocks": 0 for t in ("h1", "h2", "h3", "p")}
    return base.join(counts, "doc_id", "left").fillna(zero)


def anchored_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, page, text): the `[Page N]` blocks of a full text; without anchors it is all page 1."""
    numbers = F.regexp_extract_all(F.col("text"), F.lit(r"\[Page (\d+)\]"), F.lit(1))
    bodies = F.slice(F.split(F.col("text"), r"\[Page \d+\]"), F.lit(2), F.size(numbers))
    parts = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("page"), b.alias("text")))
    whole = F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))
    chosen = F.when(F.size(numbers) > 0, parts).otherwise(whole)
    return docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(chosen).alias("pos", "b")).select(
        "doc_id", "pos", F.col("b.page").alias("page"), F.col("b.text").alias("text")
    )


# Non-characters that mark a heading, its end, a paragraph break and a line break. A text that holds such characters has
# them spelled out with `_SPELL` meanwhile.
_MARKS = _HEAD, _HEAD_END, _BREAK, _LINE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_SPELL = "\ufdd4"


def _spelled(text: Column) -> Column:
    out = F.replace(text, F.lit(_SPELL), F.lit(f"{_SPELL}s"))
    for k, mark in enumerate(_MARKS):
        out = F.replace(out, F.lit(mark), F.lit(f"{_SPELL}{k}"))
    return F.when(text.rlike(f"[{_HEAD}-{_SPELL}]"), out).otherwise(text)


def _unspelled(text: Column) -> Column:
    out = text
    for k, mark in enumerate(_MARKS):
        out = F.replace(out, F.lit(f"{_SPELL}{k}"), F.lit(mark))
    return F.when(F.contains(text, F.lit(_SPELL)), F.replace(out, F.lit(f"{_SPELL}s"), F.lit(_SPELL))).otherwise(text)


def page_paragraphs(text: Column) -> Column:
    """Array of (section, text) of one page, by marking its lines and splitting, in linear time."""

    def mark(line: Column) -> Column:
        heading = ((F.length(line) <= 80) & F.rlike(line, F.lit(HEADING_CAPS))) | (
            (F.length(line) <= 70) & F.rlike(line, F.lit(HEADING_TITLE)) & ~F.endswith(line, F.lit("."))
        )
        return (
            F.when(F.length(line) == 0, F.lit(_BREAK))
            .when(heading, F.concat(F.lit(_HEAD), F.regexp_replace(line, ":$", ""), F.lit(_HEAD_END)))
            .otherwise(line)
        )

    marked = F.array_join(F.transform(F.transform(F.split(_spelled(text), r"\r?\n"), trim_ws), mark), _LINE)

    def paragraphs(body: Column, section: Column) -> Column:
        joined = F.transform(
            F.split(body, _BREAK), lambda p: trim_ws(F.array_join(F.filter(F.split(p, _LINE), lambda x: F.length(x) > 0), " "))
        )
        return F.transform(
            F.filter(joined, lambda p: F.length(p) > 0), lambda p: F.struct(_unspelled(section).alias("section"), _unspelled(p).alias("text"))
        )

    def of_section(piece: Column, i: Column) -> Column:
        cut = F.instr(piece, _HEAD_END)
        section = F.when(i > 0, F.substring(piece, F.lit(1), cut - 1))
        return paragraphs(F.when(i > 0, F.substring(piece, cut + 1, F.length(piece))).otherwise(piece), section)

    return F.flatten(F.transform(F.split(marked, _HEAD), of_section))


def paragraphs(pages: DataFrame, pos: str = "page") -> DataFrame:
    """(doc_id, page, paragraph_index, section, text): paragraphs indexed over the document from 0."""
    found = pages.select(
        "doc_id", *dict.fromkeys(["page", pos]), page_paragraphs(F.coalesce(F.col("text"), F.lit(""))).alias("ps")
    )
    placed = prefix_sums(found, ["doc_id"], [pos], {"base": F.size("ps")}, block_of(pos))
    return placed.select("doc_id", "page", "base", F.posexplode("ps").alias("k", "p")).select(
        "doc_id",
        "page",
        (F.col("base") + F.col("k")).cast("int").alias("paragraph_index"),
        F.col("p.section").alias("section"),
        F.col("p.text").alias("text"),
    )


def table_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, col_no, cell): non-blank lines cut at tabs and at runs of two or more blanks."""
    rows = F.filter(lines_of(F.coalesce(F.col("text"), F.lit(""))), lambda line: F.length(trim_ws(line)) > 0)
    cells = F.filter(F.transform(F.split(F.col("line"), WS + "{2,}|\t"), trim_ws), lambda c: F.length(c) > 0)
    grid = F.when(F.size(cells) > 1, cells).otherwise(F.array(trim_ws(F.col("line"))))
    return (
        docs.select("doc_id", F.posexplode(rows).alias("r", "line"))
        .select("doc_id", "r", F.posexplode(grid).alias("c", "cell"))
        .select("doc_id", (F.col("r") + 1).alias("row_no"), (F.col("c") + 1).alias("col_no"), "cell")
    )


def slides_from_text(docs: DataFrame, max_body: int | None = None) -> DataFrame:
    """(doc_id, slide_no, total, title, body): form feeds or four newlines part the slides; `max_body` (2500, say) cuts bodies."""
    pieces = F.filter(
        F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), r"\f|\n{4,}"), trim_ws), lambda p: F.length(p) > 0
    )
    some = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    first = trim_ws(F.substring_index(F.col("slide"), "\n", 1))
    at = F.instr("slide", "\n")
    rest = F.when(at > 0, trim_ws(F.substring(F.col("slide"), at + 1, F.length("slide")))).otherwise("")
    titled = (F.length(first) < SLIDE_TITLE_CHARS) & (F.length("slide") > 0)
    body = F.when(titled, rest).otherwise(F.col("slide"))
    return (
        docs.select("doc_id", some.alias("slides"))
        .select("doc_id", F.size("slides").alias("total"), F.posexplode("slides").alias("pos", "slide"))
        .select(
            "doc_id",
            (F.col("pos") + 1).alias("slide_no"),
            "total",
            F.when(titled, first).alias("title"),
            (body if max_body is None else clip(body, max_body)).alias("body"),
        )
    )


# ---- positioned text ------------------------------------------------------------------------------------------------


def _fit(ys: Iterable[float], band: float) -> list[int]:
    """For each height the place of the first one that opened a line less than `band` from it."""
    opened: dict[float, list[tuple[int, float]]] = {}
    found = []
    for n, y in enumerate(ys):
        cell = y // band if band > 0 else y
        near = [line for c in (cell - 1, cell, cell + 1) for line in opened.get(c, ()) if abs(line[1] - y) < band]
        if not near:
            opened.setdefault(cell, []).append((n, y))
        found.append(min(near)[0] if near else n)
    return found


def first_fit(heights: DataFrame, keys: list[str], band: float) -> DataFrame:
    """(keys, y, line_y): every height of (keys, y, seq) with the first line, in the order of seq, that opened less than `band` from it.

    Open lines lie `band` apart: about one per cell of that height, and a height looks at its own and both neighbouring
    cells. The work is one look-up a height, whatever the number of lines; a page's heights are one cell. Null heights are
    on no line; heights that are no finite number, and all heights if `band` is not above zero, have a line each.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lines_of_pages(pages: pd.Series) -> pd.Series:
        return pages.map(lambda ys: _fit(ys.tolist(), band))

    seen = F.struct("seq", F.col("y").cast("double").alias("y"))
    per_page = heights.filter(F.col("y").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(seen)).getField("y").alias("_ys"))
    placed = per_page.select(*keys, "_ys", lines_of_pages("_ys").alias("_lines"))
    pair = F.transform("_lines", lambda line, n: F.struct(F.get("_ys", n).alias("y"), F.get("_ys", line).alias("line_y")))
    return placed.select(*keys, F.inline(pair))


def items_to_lines(items: DataFrame, mode: str = "anchor", tolerance: float | None = None, per_page: int = PAGE_ITEMS) -> DataFrame:
    """(doc_id, page, line_no, y, text, items): positioned items grouped into lines, top to bottom.

    'anchor': from the top down, an item joins the open line while it is within the tolerance of the line's first item.
    'first_fit': in input order, an item joins the first line opened within the band. Either way the line depends on
    the y coordinate alone, so lines are found on the distinct coordinates of a page; items are ordered by (x, seq).

    Pages of at most `per_page` items are packed where they are read, shuffled once and made by one task each. Larger ones,
    and pages with coordinates that are no finite numbers or places in the order that are null, go by blocks of height.
    """
    inked = items.filter((F.length(trim_ws(F.col("text"))) > 0) & F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("y").isNotNull())
    keys = ["doc_id", "page"]
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    plain = finite("x") & finite("y") & F.col("seq").isNotNull()
    sizes = inked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(plain).alias("plain"))
    large = stage_table(sizes.filter((F.col("n") > per_page) | ~F.col("plain")).select(*keys))
    small = inked if large.isEmpty() else inked.join(large, keys, "left_anti")
    return _lines_together(small, mode, tolerance).unionByName(_lines_by_height(inked.join(large, keys, "left_semi"), mode, tolerance))


def _lines_together(inked: DataFrame, mode: str, tolerance: float | None) -> DataFrame:
    """Lines of pages that one task can hold. Items are packed by page in the batches they come in, column by column."""
    box, keys = ("x", "seq", "text", "y", "w", "h"), ("doc_id", "page")
    anchor = mode == "anchor"
    limit = float(tolerance if tolerance is not None else LINE_TOLERANCE if anchor else LINE_BAND)
    rows = inked.select(*keys, *box)
    field = {f.name: f for f in rows.schema.fields}
    packed_schema = T.StructType([field["doc_id"], field["page"], T.StructField("size", T.LongType()), T.StructField("packed", T.BinaryType())])
    found = [T.StructField("line_no", T.IntegerType()), T.StructField("y", T.DoubleType()), T.StructField("text", T.StringType())]
    boxes_type = T.StructType([T.StructField(c, field[c].dataType) for c in box])
    schema = T.StructType([field["doc_id"], field["page"], *found, T.StructField("items", T.ArrayType(boxes_type))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch, sort_keys=[(k, "ascending") for k in keys]))
            new = pc.or_(*[pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]) for k in keys])
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            sizes, blobs = [], []
            for a, b in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                part = batch.slice(a, b - a).select(box)
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                raw = sink.getvalue()
                sizes.append(raw.size)
                blobs.append(pa.compress(raw, codec="zstd", asbytes=True))
            first = batch.select(keys).take(pa.array(cuts[:-1]))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], [*keys, "size", "packed"])

    def line_heights(page: pa.Table) -> np.ndarray:
        """The height of the line of every item."""
        ys = page["y"].to_numpy().astype(np.float64) + 0.0
        if anchor:
            down, place = np.unique(-ys, return_inverse=True)
            return -block_anchors(down, down, np.zeros(len(down), bool), limit, NO_ANCHOR)[place] + 0.0
        heights, place = np.unique(ys, return_inverse=True)
        ranks = pc.rank(page["seq"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        seen = np.full(len(heights), len(ys) + 1)
        np.minimum.at(seen, place, ranks)
        order = np.lexsort((heights, seen))
        lines = np.empty(len(heights))
        lines[order] = heights[order][_fit(heights[order].tolist(), limit)]
        return lines[place]

    def build(group: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(pa.decompress(blob, size, codec="zstd")).read_all() for size, blob in zip(group["size"].to_pylist(), group["packed"].to_pylist())]
        page = pa.concat_tables(parts).combine_chunks()
        down = -line_heights(page)
        order = pc.sort_indices(page.append_column("_down", pa.array(down)), sort_keys=[(c, "ascending") for c in ("_down", *box)], null_placement="at_start")
        page, down = page.take(order).combine_chunks(), down[order.to_numpy()]
        starts = np.flatnonzero(np.append(True, down[1:] != down[:-1]))
        cuts = np.append(starts, len(down))
        words = page["text"].to_pylist()
        texts = [" ".join(words[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        boxes = pa.StructArray.from_arrays([page[c].combine_chunks() for c in box], names=box)
        columns = {k: pa.repeat(group[k][0], len(starts)) for k in keys}
        columns |= {"line_no": pa.array(np.arange(1, len(starts) + 1), pa.int32()), "y": pa.array(-down[starts] + 0.0)}
        columns |= {"text": pa.array(texts if anchor else [t.strip(WS_CHARS) for t in texts], pa.string()), "items": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), boxes)}
        return pa.table(columns)

    return rows.mapInArrow(pack, packed_schema).groupBy(*keys).applyInArrow(build, schema)


def _lines_by_height(inked: DataFrame, mode: str, tolerance: float | None) -> DataFrame:
    """As `_lines_together`, for pages of any size: heights and items meet in joins."""
    keys = ["doc_id", "page"]
    if mode == "anchor":
        tol = LINE_TOLERANCE if tolerance is None else tolerance
        down = inked.withColumn("_down", -F.col("y"))
        lines = point_segments(down, keys, "_down", tol, F.floor(F.col("_down") / 1000).cast("bigint"))
        # heights are unpacked from a small staged table, so the planner thinks them few; they are never copied to all tasks
        placed = down.join(lines.hint("merge"), [*keys, "_down"]).withColumn("line_y", -F.col("anchor"))
    else:
        band = LINE_BAND if tolerance is None else tolerance
        seen = inked.groupBy(*keys, "y").agg(F.min("seq").alias("seq"))

        lines = first_fit(seen, keys, float(band))
        placed = inked.join(lines.hint("merge"), [*keys, "y"])
    box = F.struct("x", "seq", "text", "y", "w", "h")
    grouped = placed.groupBy(*keys, "line_y").agg(F.sort_array(F.collect_list(box)).alias("items"))
    if mode == "anchor":
        text = F.array_join(F.col("items.text"), " ")
    else:
        text = trim_ws(F.array_join(F.col("items.text"), " "))
    made = grouped.withColumn("text", text)
    # lines of a page lie tolerance apart, so 1000 units of height hold a bounded number of them
    return number_rows(
        made.withColumn("_down", -F.col("line_y")), keys, ["_down"], F.floor(F.col("_down") / 1000).cast("bigint"), "line_no"
    ).select(*keys, "line_no", F.col("line_y").alias("y"), "text", "items")
