"""Registered queries: pagination, cleaning, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import chunking, cleaning, pagination
from leafmill.operators.cleaning import NUMBER_LINE
from leafmill.functions.text import WS
from leafmill.plans import inputs as i
from leafmill.plans.inputs import q, squeeze_sql, trim_sql, with_ctes

QUERIES = {}
ORACLES = {}


# ---- pagination -----------------------------------------------------------------------------------------------------

QUERIES["paginate_fixed"] = lambda s, d: i.doc_pages(s, d)
ORACLES["paginate_fixed"] = with_ctes(i.doc_pages_sql(), "SELECT * FROM doc_pages")


def _scanned_pages(s, d):
    """Pages of 50 characters; pages ending a document are short and some of them count as OCR results."""
    return i.doc_pages(s, d, 50).withColumn("was_ocr", (F.col("char_count") < 40) & (F.col("page") % 2 == 1))


QUERIES["scan_profile"] = lambda s, d: pagination.scan_profile(_scanned_pages(s, d))
ORACLES["scan_profile"] = with_ctes(
    i.doc_pages_sql("p50", 50),
    f"""SELECT doc_id, count(*) AS total_pages,
  count(*) FILTER (WHERE char_count < 40 AND page % 2 = 1) AS scanned_pages,
  count(*) FILTER (WHERE length(regexp_replace(text, {q(WS + '+')}, '', 'g')) < 30) AS ocr_needed,
  count(*) FILTER (WHERE char_count < 40 AND page % 2 = 1) = count(*) AS is_fully_scanned,
  count(*) FILTER (WHERE char_count < 40 AND page % 2 = 1) > 0 AS has_scanned_content
FROM p50 GROUP BY doc_id""",
)

_TEMPLATES = {"header_left": "{Title}", "header_right": "{DATE}", "footer_left": "p{page}-{page}"}


def _page_labels(s, d):
    docs = i.documents(s, d).select("doc_id", F.concat_ws(" ", "source", F.lit("$1"), "lang").alias("title"))
    return pagination.page_labels(
        i.doc_pages(s, d).select("doc_id", "page"), docs, _TEMPLATES, today="24/12/2025", start_page=2, end_page=9
    )


QUERIES["page_labels"] = _page_labels
ORACLES["page_labels"] = with_ctes(
    i.doc_pages_sql(),
    """, totals AS (SELECT doc_id, count(*) AS total FROM doc_pages GROUP BY doc_id)
SELECT p.doc_id, p.page, s.slot,
  CASE s.slot WHEN 'header_left' THEN d.source || ' $1 ' || d.lang WHEN 'header_right' THEN '24/12/2025'
    WHEN 'footer_left' THEN 'p' || p.page || '-' || p.page ELSE p.page || ' / ' || t.total END AS text
FROM doc_pages p JOIN totals t USING (doc_id) JOIN documents d USING (doc_id)
CROSS JOIN (VALUES ('header_left'), ('header_right'), ('footer_left'), ('footer_center')) s(slot)
WHERE p.page >= 2 AND p.page <= least(9, t.total)""",
)


# ---- cleaning -------------------------------------------------------------------------------------------------------


def clean_sql(expr: str) -> str:
    joined = f"regexp_replace({expr}, '(\\w)-\\n(\\w)', '\\1\\2', 'g')"
    spaced = f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    numbers = f"regexp_replace({spaced}, {q(NUMBER_LINE)}, '', 'g')"
    line = trim_sql(f"regexp_replace(x, {q(WS + '{2,}')}, ' ', 'g')")
    return trim_sql(f"array_to_string(list_transform(string_split({numbers}, chr(10)), lambda x: {line}), chr(10))")


def cleaned_book_sql(name: str = "cleaned") -> str:
    return f"{i.book_pages_sql()},\n{name} AS (SELECT doc_id, page, {clean_sql('text')} AS text FROM book_pages)"


def refined_book_sql(name: str = "refined") -> str:
    """Cleaned and stripped of repeated lines, spelled with exploded lines and an anti join."""
    return f"""{cleaned_book_sql()},
{name}_lines AS (
  SELECT doc_id, page, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, page, string_split(text, chr(10)) AS ls FROM cleaned)),
{name}_sizes AS (SELECT doc_id, count(*) AS pages FROM cleaned GROUP BY doc_id),
{name}_furniture AS (
  SELECT l.doc_id, l.t FROM (SELECT DISTINCT doc_id, page, {trim_sql('line')} AS t FROM {name}_lines) l
  JOIN {name}_sizes s USING (doc_id) WHERE length(l.t) > 3 AND s.pages >= 3
  GROUP BY l.doc_id, l.t, s.pages HAVING count(*) >= greatest(3, ceil(s.pages * 0.6))),
{name}_kept AS (
  SELECT l.* FROM {name}_lines l ANTI JOIN {name}_furniture f ON f.doc_id = l.doc_id AND f.t = {trim_sql('l.line')}),
{name} AS (
  SELECT c.doc_id, c.page, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos), '') AS text
  FROM cleaned c LEFT JOIN {name}_kept k USING (doc_id, page) GROUP BY c.doc_id, c.page)"""


QUERIES["clean_pages"] = lambda s, d: cleaning.clean_pages(i.book_pages(s, d), audit=True)
ORACLES["clean_pages"] = with_ctes(
    cleaned_book_sql(),
    """SELECT c.doc_id, c.page, c.text, length(b.text)::INTEGER AS chars_before, length(c.text)::INTEGER AS chars_after
FROM cleaned c JOIN book_pages b USING (doc_id, page)""",
)

QUERIES["repeated_lines"] = lambda s, d: cleaning.repeated_lines(cleaning.clean_pages(i.book_pages(s, d))).select(
    "doc_id", F.explode("furniture").alias("line")
)
ORACLES["repeated_lines"] = with_ctes(refined_book_sql(), "SELECT doc_id, t AS line FROM refined_furniture")

QUERIES["drop_repeated_lines"] = lambda s, d: cleaning.drop_repeated_lines(cleaning.clean_pages(i.book_pages(s, d)))
ORACLES["drop_repeated_lines"] = with_ctes(refined_book_sql(), "SELECT doc_id, page, text FROM refined")


def _clean_corpus(s, d):
    kind = F.when(F.col("doc_id").endswith("5"), F.lit("txt")).otherwise(F.lit("pdf"))
    return cleaning.clean_corpus(i.book_pages(s, d), kind)


QUERIES["clean_corpus"] = _clean_corpus
ORACLES["clean_corpus"] = with_ctes(
    refined_book_sql(),
    """SELECT r.doc_id, r.page, CASE WHEN r.doc_id LIKE '%5' THEN b.text ELSE r.text END AS text
FROM refined r JOIN book_pages b USING (doc_id, page)""",
)

QUERIES["truncate_docs"] = lambda s, d: cleaning.truncate_docs(
    i.documents(s, d).select("doc_id", "text"), 4000
).drop("text")
ORACLES["truncate_docs"] = f"""SELECT doc_id, length(text) > 4000 AS was_truncated,
  CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || {q(cleaning.TRUNCATION_MARK)} ELSE text END AS truncated
FROM documents"""

QUERIES["truncation_report"] = lambda s, d: cleaning.truncation_report(i.documents(s, d), "source", 4000)
ORACLES["truncation_report"] = """SELECT source, count(*) AS docs, count(*) FILTER (WHERE length(text) > 4000) AS truncated_docs,
  round(avg(CASE WHEN length(text) > 4000 THEN 1.0 ELSE 0.0 END), 6) AS truncated_share
FROM documents GROUP BY source"""

QUERIES["input_limits"] = lambda s, d: cleaning.input_limits(
    i.documents(s, d).select("doc_id", "text", F.substring("text", 1, 2500).alias("question")), max_text=20000, question="question"
).select("doc_id", "reject_reason")
ORACLES["input_limits"] = """SELECT doc_id, CASE WHEN length(text) > 20000 THEN 'text too long'
  WHEN length(substring(text, 1, 2500)) > 2000 THEN 'question too long' END AS reject_reason FROM documents"""

QUERIES["sufficiency"] = lambda s, d: cleaning.sufficiency(
    i.documents(s, d).select("doc_id", F.concat(F.lit("[Page 3] [Sheet a b]\n"), F.substring_index("text", ".", 1)).alias("text"))
)
ORACLES["sufficiency"] = f"""SELECT doc_id, n AS plain_len, n < 40 AS insufficient FROM (
  SELECT doc_id, length({squeeze_sql(r"regexp_replace(regexp_replace(regexp_replace('[Page 3] [Sheet a b]' || chr(10) || split_part(text, '.', 1), '\[Page \d+\]', ' ', 'g'), '\[Slide \d+\]', ' ', 'g'), '\[Sheet [^\]]+\]', ' ', 'g')")})::INTEGER AS n
  FROM documents)"""


# ---- chunking -------------------------------------------------------------------------------------------------------


def _flat(chunks):
    return chunks.select("doc_id", "chunk_id", "text", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


QUERIES["chunk_pages"] = lambda s, d: _flat(chunking.chunk_pages(i.doc_pages(s, d)))
ORACLES["chunk_pages"] = with_ctes(
    i.doc_pages_sql() + ",\n" + i.chunks_sql("doc_pages", 4800),
    "SELECT doc_id, chunk_id, text, array_to_string(pages, ',') AS pages FROM chunks",
)

QUERIES["chunk_book_pages"] = lambda s, d: _flat(
    chunking.chunk_pages(cleaning.clean_corpus(i.book_pages(s, d)), 3000)
)
ORACLES["chunk_book_pages"] = with_ctes(
    refined_book_sql() + ",\n" + i.chunks_sql("refined", 3000),
    "SELECT doc_id, chunk_id, text, array_to_string(pages, ',') AS pages FROM chunks",
)

QUERIES["chunk_overlap"] = lambda s, d: chunking.chunk_overlap(i.documents(s, d), 2000, 100)
QUERIES["chunk_overlap_limited"] = lambda s, d: chunking.chunk_overlap(i.documents(s, d), 2000, 100, 5)


def parts_sql(size: int, overlap: int, max_parts: int = 1_000_000, name: str = "parts") -> str:
    tail = f"substring(text, least(pos + {size}, length(text)) - 1999, 2000)"

    def last(mark: str, n: int) -> str:
        rev = f"strpos(reverse({tail}), reverse({mark}))"
        return f"CASE WHEN {rev} = 0 THEN -1 ELSE 2000 - {rev} + 1 - {n} END"

    best = "greatest(" + ", ".join(
        [last("chr(10) || chr(10)", 2), last("'. '", 2), last("chr(10)", 1), last("' '", 1)]
    ) + ")"
    cut = f"""CASE WHEN pos + {size} < length(text) AND {best} > 0 AND 2000 - {best} < 1500
      THEN least(pos + {size}, length(text)) - (2000 - {best}) ELSE least(pos + {size}, length(text)) END"""
    return f"""{name}_walk AS (
  SELECT doc_id, text, 0 AS chunk_no, pos, ({cut})::BIGINT AS cut FROM (SELECT doc_id, text, 0::BIGINT AS pos FROM documents)
  UNION ALL
  SELECT doc_id, text, chunk_no + 1, pos, ({cut})::BIGINT FROM (
    SELECT doc_id, text, chunk_no, greatest(cut - {overlap}, pos + 1) AS pos FROM {name}_walk
    WHERE cut < length(text) AND chunk_no < {max_parts - 1})),
{name}_raw AS (
  SELECT *, substring(text, pos + 1, cut - pos) AS piece, substring(text, greatest(cut - {overlap}, pos + 1) + 1) AS rest
  FROM {name}_walk),
{name} AS (
  SELECT doc_id, chunk_no, piece || CASE WHEN chunk_no < {max_parts - 1} OR cut >= length(text) OR rest = '' OR rest = piece THEN ''
    WHEN length(rest) > {size} THEN {q(chunking.PART_TRUNCATED)} ELSE chr(10) || chr(10) || rest END AS text
  FROM {name}_raw)"""


ORACLES["chunk_overlap"] = with_ctes(parts_sql(2000, 100), "SELECT doc_id, chunk_no, text FROM parts")
ORACLES["chunk_overlap_limited"] = with_ctes(parts_sql(2000, 100, 5), "SELECT doc_id, chunk_no, text FROM parts")


def _head(text: str, no: int) -> str:
    if text.startswith("A"):
        raise ValueError("unreadable part")
    return f"{no}:{text[:20].lower()}"


def _map_reduce(s, d):
    out = chunking.map_reduce_docs(
        i.documents(s, d), _head, lambda parts: "|".join(parts), threshold=2500, size=2000, overlap=100
    )
    return out.select("doc_id", "content", "chunked", "chunk_count", F.array_join("parts", "~").alias("parts"), "error")


QUERIES["map_reduce_docs"] = _map_reduce
ORACLES["map_reduce_docs"] = with_ctes(
    parts_sql(2000, 100),
    """, todo AS (
  SELECT d.doc_id, 0 AS chunk_no, d.text, false AS chunked FROM documents d WHERE length(d.text) <= 2500
  UNION ALL SELECT p.doc_id, p.chunk_no, p.text, true FROM parts p JOIN documents d USING (doc_id) WHERE length(d.text) > 2500),
mapped AS (
  SELECT *, CASE WHEN text NOT LIKE 'A%' THEN chunk_no || ':' || lower(substring(text, 1, 20)) END AS part FROM todo)
SELECT doc_id, string_agg(part, '|' ORDER BY chunk_no) AS content, bool_or(chunked) AS chunked, count(*)::INTEGER AS chunk_count,
  coalesce(string_agg(part, '~' ORDER BY chunk_no), '') AS parts, CASE WHEN count(part) = 0 THEN 'unreadable part' END AS error
FROM mapped GROUP BY doc_id""",
)
