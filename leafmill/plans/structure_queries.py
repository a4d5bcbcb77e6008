"""Registered queries: HTML, paragraphs, blocks, cells, slides, positioned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import WS
from leafmill.operators import structure
from leafmill.operators.pagination import paginate_fixed
from leafmill.operators.structure import HEADING_CAPS, HEADING_TITLE
from leafmill.plans import inputs as i
from leafmill.plans.inputs import q, squeeze_sql, trim_sql, with_ctes
from leafmill.session import table

QUERIES = {}
ORACLES = {}


# ---- HTML -----------------------------------------------------------------------------------------------------------


def html_pages(s, d) -> DataFrame:
    """The web pages, with some entities written as numbers."""
    html = F.replace(F.replace("html", F.lit("&copy;"), F.lit("&#169;&#8364;&amp;lt;")), F.lit("&middot;"), F.lit("&#183;&nbsp;&apos;"))
    return table(s, d, "pages").select("page_id", "url", html.alias("html"))


HTML_PAGES_SQL = """html_pages AS (
  SELECT page_id, url, replace(replace(html, '&copy;', '&#169;&#8364;&amp;lt;'), '&middot;', '&#183;&nbsp;&apos;') AS html FROM pages)"""


def plain_sql(expr: str) -> str:
    t = f"regexp_replace(regexp_replace({expr}, '(?i)<script[^>]*>[\\s\\S]*?</script>', '', 'g'), '(?i)<style[^>]*>[\\s\\S]*?</style>', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        t = f"replace({t}, {q(name)}, {q(char)})"
    # the only numeric entities these pages contain
    for code in (169, 8364, 183):
        t = f"replace({t}, '&#{code};', chr({code}))"
    return squeeze_sql(t)


QUERIES["html_to_text"] = lambda s, d: structure.html_to_text(html_pages(s, d)).select("page_id", "text")
ORACLES["html_to_text"] = with_ctes(HTML_PAGES_SQL, f"SELECT page_id, {plain_sql('html')} AS text FROM html_pages")


def _chapters(s, d, title_chars=None):
    """All pages of a language as one book, with a nearly empty part and a part without headings after each."""
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    versions = F.array("html", F.lit("<p>ab</p>"), F.regexp_replace("html", "(?i)</?h[1-3]>", ""))
    parts = html_pages(s, d).select(lang.alias("doc_id"), "page_id", F.posexplode(versions).alias("k", "html"))
    return structure.html_chapters(parts.select("doc_id", (F.col("page_id") * 3 + F.col("k")).alias("pos"), "html"), title_chars)


QUERIES["html_chapters_limited"] = lambda s, d: _chapters(s, d, structure.TITLE_CHARS)
ORACLES["html_chapters_limited"] = with_ctes(
    HTML_PAGES_SQL,
    f""", parts AS (
  SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS doc_id, page_id * 3 + k AS pos,
    CASE k WHEN 1 THEN '<p>ab</p>' WHEN 2 THEN regexp_replace(html, '(?i)</?h[1-3]>', '', 'g') ELSE html END AS html
  FROM html_pages, range(0, 3) r(k)),
read AS (
  SELECT doc_id, pos, {plain_sql('html')} AS text,
    CASE WHEN regexp_matches(html, '(?i)<h[1-3][^>]*>[\\s\\S]*?</h[1-3]>')
      THEN substring({plain_sql("regexp_extract(html, '(?i)<h[1-3][^>]*>([\\s\\S]*?)</h[1-3]>', 1)")}, 1, 100) END AS title
  FROM parts),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS page FROM read WHERE length(text) >= 5)
SELECT doc_id, page, text, false AS was_ocr, length(text)::INTEGER AS char_count, coalesce(title, 'Chapter ' || page) AS chapter_title FROM numbered""",
)
QUERIES["html_chapters"] = _chapters
ORACLES["html_chapters"] = ORACLES["html_chapters_limited"].replace(", 1, 100) END AS title", ", 1) END AS title")

QUERIES["html_blocks"] = lambda s, d: structure.html_blocks(html_pages(s, d))


def _html_blocks_sql() -> str:
    """Pieces between and at headings as rows, their lines as rows, then blank runs and ends by windows."""
    heading = "(?i)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>"
    t = "piece"
    for pattern, into in (
        ("</p>", "chr(10) || chr(10)"), ("<br\\s*/?>|</li>", "chr(10)"), ("<li[^>]*>", "'• '"),
        ("<(strong|b)[^>]*>(.*?)</(strong|b)>", "'**\\2**'"), ("<(em|i)[^>]*>(.*?)</(em|i)>", "'_\\2_'"), ("<[^>]*>", "''"),
    ):
        t = f"regexp_replace({t}, '(?i){pattern}', {into}, 'g')"
    for name, char in structure.BLOCK_ENTITIES:
        t = f"replace({t}, {q(name)}, {q(char)})"
    return with_ctes(
        HTML_PAGES_SQL,
        f""", bare AS (SELECT page_id, regexp_replace(html, '(?i)<script[^>]*>[\\s\\S]*?</script>|<style[^>]*>[\\s\\S]*?</style>', '', 'g') AS body FROM html_pages),
pieces AS (
  SELECT page_id, 2 * generate_subscripts(fs, 1) AS place, 'text' AS kind, unnest(fs) AS piece FROM (SELECT page_id, string_split_regex(body, '{heading}') AS fs FROM bare)
  UNION ALL
  SELECT page_id, place, lower(piece[2:3]) AS kind, piece FROM (
    SELECT page_id, 2 * generate_subscripts(hs, 1) + 1 AS place, unnest(hs) AS piece FROM (SELECT page_id, regexp_extract_all(body, '{heading}') AS hs FROM bare))),
lines AS (
  SELECT page_id, place, k, line, CASE WHEN k = 1 THEN kind ELSE 'text' END AS kind FROM (
    SELECT page_id, place, kind, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT page_id, place, kind, string_split({t}, chr(10)) AS ls FROM pieces))),
single AS (
  SELECT *, kind <> 'text' OR {trim_sql('line')} <> '' AS inked FROM lines
  QUALIFY NOT (kind = 'text' AND line = '' AND coalesce(lag(kind = 'text' AND line = '') OVER (PARTITION BY page_id ORDER BY place, k), false))),
ends AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place, k) AS n, bool_or(inked) OVER (PARTITION BY page_id) AS any_ink,
    bool_or(inked) OVER (PARTITION BY page_id ORDER BY place, k) AS begun, bool_or(inked) OVER (PARTITION BY page_id ORDER BY place DESC, k DESC) AS to_come FROM single)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n))::INTEGER AS line_no, CASE WHEN inked THEN kind ELSE 'blank' END AS block_type, {trim_sql('line')} AS text
FROM ends WHERE (begun AND to_come) OR (NOT any_ink AND n = 1)""",
    )


ORACLES["html_blocks"] = _html_blocks_sql()


# ---- plain text -----------------------------------------------------------------------------------------------------


def headed_docs(s, d) -> DataFrame:
    """Documents with headings and blank lines put in."""
    text = F.concat(
        F.lit("SOURCE REPORT 7:\n\nChapter on "), "lang", F.lit("\n \nPart  list\n\n"),
        F.replace("text", F.lit(".\n"), F.lit(".\n\nShort Title Line\n")), F.lit("\n\nfigures  1\t2\n"),
    )
    return i.documents(s, d).select("doc_id", text.alias("text"))


HEADED_SQL = """headed AS (
  SELECT doc_id, 'SOURCE REPORT 7:' || chr(10) || chr(10) || 'Chapter on ' || lang || chr(10) || ' ' || chr(10) || 'Part  list'
    || chr(10) || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || chr(10) || 'Short Title Line' || chr(10))
    || chr(10) || chr(10) || 'figures  1' || chr(9) || '2' || chr(10) AS text FROM documents)"""

BLOCKS_SQL = f"""{HEADED_SQL},
raw_blocks AS (
  SELECT doc_id, unnest(bs) AS content, generate_subscripts(bs, 1)::INTEGER AS block_no FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {q(chr(92) + 'n' + WS + '*' + chr(92) + 'n')}),
      lambda b: {squeeze_sql('b')}), lambda b: length(b) > 0) AS bs FROM headed)),
blocks AS (
  SELECT doc_id, block_no, content, CASE
    WHEN length(content) < 120 AND content = upper(content) AND length(content) > 2 AND NOT regexp_matches(content, '[.!?,;:]$') THEN 'h2'
    WHEN length(content) < 120 AND NOT regexp_matches(content, '[.!?,;:]$') AND regexp_matches(content, '(?i)^(chapter|section|part)\\s') THEN 'h1'
    WHEN length(content) < 60 AND NOT regexp_matches(content, '[.!?,;:]$') THEN 'h3' ELSE 'p' END AS type FROM raw_blocks)"""

QUERIES["text_blocks"] = lambda s, d: structure.text_blocks(headed_docs(s, d))
ORACLES["text_blocks"] = with_ctes(BLOCKS_SQL, "SELECT * FROM blocks")

QUERIES["reflow_stats"] = lambda s, d: structure.reflow_stats(headed_docs(s, d))
ORACLES["reflow_stats"] = with_ctes(
    BLOCKS_SQL,
    f"""SELECT h.doc_id, length({trim_sql('any_value(h.text)')}) > 50 AS has_text,
  len(regexp_split_to_array({trim_sql('any_value(h.text)')}, {q(WS + '+')}))::INTEGER AS word_count,
  {', '.join(f"count(*) FILTER (WHERE b.type = '{t}') AS {t}_blocks" for t in ('h1', 'h2', 'h3', 'p'))}
FROM headed h LEFT JOIN blocks b USING (doc_id) GROUP BY h.doc_id""",
)


def headed_pages(s, d) -> DataFrame:
    return paginate_fixed(headed_docs(s, d), 1000)


HEADED_PAGES_SQL = HEADED_SQL + ",\n" + i.doc_pages_sql("headed_pages", 1000).replace("FROM documents", "FROM headed")


def paragraphs_sql(pages: str, name: str = "paras", order: str = "page") -> str:
    line = trim_sql("raw")
    return f"""{name}_lines AS (
  SELECT doc_id, page, {order} AS ord, {line} AS line, n FROM (
    SELECT doc_id, page, {order}, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n
    FROM (SELECT *, regexp_split_to_array(text, '\\r?\\n') AS ls FROM {pages}))),
{name}_marked AS (
  SELECT *, (length(line) <= 80 AND regexp_matches(line, {q(HEADING_CAPS)}))
    OR (length(line) <= 70 AND regexp_matches(line, {q(HEADING_TITLE)}) AND NOT line LIKE '%.') AS heading FROM {name}_lines),
{name}_grouped AS (
  SELECT *, count(*) FILTER (WHERE heading OR line = '') OVER (PARTITION BY doc_id, ord ORDER BY n) AS g,
    last_value(CASE WHEN heading THEN regexp_replace(line, ':$', '') END IGNORE NULLS) OVER (PARTITION BY doc_id, ord ORDER BY n) AS section
  FROM {name}_marked),
{name} AS (
  SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, g) - 1)::INTEGER AS paragraph_index, section, text FROM (
    SELECT doc_id, page, ord, g, any_value(section) AS section, string_agg(line, ' ' ORDER BY n) AS text
    FROM {name}_grouped WHERE NOT heading AND line <> '' GROUP BY doc_id, page, ord, g))"""


QUERIES["paragraphs"] = lambda s, d: structure.paragraphs(headed_pages(s, d))
ORACLES["paragraphs"] = with_ctes([HEADED_PAGES_SQL, paragraphs_sql("headed_pages")], "SELECT * FROM paras")


def _anchored(s, d):
    """Full texts: a stray start, then two anchored halves; French ones have no anchors."""
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.when(F.col("lang") == "fr", F.col("text")).otherwise(
        F.concat(F.lit("stray\n[Page 4]\n"), F.substring(F.col("text"), F.lit(1), half), F.lit("\n[Page 2]\nTHE END\n"), F.substring(F.col("text"), half + 1, F.length("text")))
    )
    return i.documents(s, d).select("doc_id", text.alias("text"))


QUERIES["paragraphs_anchored"] = lambda s, d: structure.paragraphs(structure.anchored_pages(_anchored(s, d)), "pos")
ORACLES["paragraphs_anchored"] = with_ctes(
    """blocks AS (
  SELECT doc_id, 0 AS pos, 1 AS page, text FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, 0, 4, chr(10) || substring(text, 1, length(text) // 2) || chr(10) FROM documents WHERE lang <> 'fr'
  UNION ALL SELECT doc_id, 1, 2, chr(10) || 'THE END' || chr(10) || substring(text, length(text) // 2 + 1) FROM documents WHERE lang <> 'fr'),
"""
    + paragraphs_sql("blocks", order="pos"),
    "SELECT * FROM paras",
)

QUERIES["table_rows"] = lambda s, d: structure.table_rows(headed_docs(s, d))
ORACLES["table_rows"] = with_ctes(
    HEADED_SQL,
    f""", lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS row_no
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length({trim_sql('x')}) > 0) AS ls FROM headed)),
cut AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(line, {q(WS + '{2,}|' + chr(92) + 't')}), lambda c: {trim_sql('c')}), lambda c: length(c) > 0) AS cs FROM lines),
grid AS (SELECT doc_id, row_no, CASE WHEN len(cs) > 1 THEN cs ELSE [{trim_sql('line')}] END AS cs FROM cut)
SELECT doc_id, row_no, generate_subscripts(cs, 1)::INTEGER AS col_no, unnest(cs) AS cell FROM grid""",
)


def _slides(s, d):
    """Documents with wide gaps, some with a closing page; and a blank document beside each Spanish one."""
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n\n\n"))
    closed = F.when(F.col("lang") == "de", F.concat(text, F.lit("\fThank you"))).otherwise(text)
    docs = i.documents(s, d)
    blank = docs.filter("lang = 'es'").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("  \n ").alias("text"))
    return structure.slides_from_text(docs.select("doc_id", closed.alias("text")).unionByName(blank))


QUERIES["slides_from_text"] = _slides
ORACLES["slides_from_text"] = with_ctes(
    f"""src AS (
  SELECT doc_id, replace(text, '.' || chr(10), '.' || repeat(chr(10), 4)) || CASE lang WHEN 'de' THEN chr(12) || 'Thank you' ELSE '' END AS text FROM documents
  UNION ALL SELECT -1 - doc_id, '  ' || chr(10) || ' ' FROM documents WHERE lang = 'es'),
cut AS (
  SELECT doc_id, CASE WHEN len(ps) = 0 THEN [''] ELSE ps END AS ps FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\f|\\n{{4,}}'), lambda p: {trim_sql('p')}), lambda p: length(p) > 0) AS ps FROM src)),
slide AS (SELECT doc_id, len(ps)::INTEGER AS total, unnest(ps) AS s, generate_subscripts(ps, 1)::INTEGER AS slide_no FROM cut),
parts AS (SELECT *, {trim_sql("split_part(s, chr(10), 1)")} AS first,
  CASE WHEN contains(s, chr(10)) THEN {trim_sql("substring(s, strpos(s, chr(10)) + 1)")} ELSE '' END AS rest FROM slide)""",
    """SELECT doc_id, slide_no, total, CASE WHEN length(first) < 80 AND s <> '' THEN first END AS title,
  CASE WHEN length(first) < 80 AND s <> '' THEN rest ELSE s END AS body FROM parts""",
)


# ---- positioned items -----------------------------------------------------------------------------------------------


def text_items(s, d) -> DataFrame:
    """Every word of a document as a positioned item: ten words to a row, rows 4 apart, words jittered by 0 to 2."""
    words = F.filter(F.split("text", WS + "+"), lambda w: F.length(w) > 0)
    k = F.col("k")
    row, col = F.floor(k / 10) % 150, k % 10
    return i.documents(s, d).select("doc_id", F.posexplode(words).alias("k", "text")).select(
        "doc_id",
        (F.floor(k / 1500) + 1).cast("int").alias("page"),
        F.col("k").alias("seq"),
        "text",
        (50 + 47 * ((col * 7) % 10)).cast("double").alias("x"),
        (760 - 4 * row + (k * 5) % 3).cast("double").alias("y"),
        (6 * F.length("text")).cast("double").alias("w"),
        F.lit(10.0).alias("h"),
        F.lit("F1").alias("font"),
    )


ITEMS_SQL = f"""items AS (
  SELECT doc_id, (k // 1500 + 1)::INTEGER AS page, k AS seq, text, (50 + 47 * (((k % 10) * 7) % 10))::DOUBLE AS x,
         (760 - 4 * ((k // 10) % 150) + (k * 5) % 3)::DOUBLE AS y, (6 * length(text))::DOUBLE AS w, 10.0::DOUBLE AS h
  FROM (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, {q(WS + '+')}), lambda w: length(w) > 0) AS ws FROM documents)))"""

LINES_SQL = f"""{ITEMS_SQL},
ys AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS i
  FROM (SELECT DISTINCT doc_id, page, y FROM items)),
anchor_fold AS (
  SELECT doc_id, page, i, y, y AS line_y FROM ys WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.i, n.y, CASE WHEN abs(n.y - f.line_y) <= 3 THEN f.line_y ELSE n.y END
  FROM anchor_fold f JOIN ys n ON n.doc_id = f.doc_id AND n.page = f.page AND n.i = f.i + 1),
lines AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_y DESC)::INTEGER AS line_no, line_y AS y, text, boxes
  FROM (SELECT t.doc_id, t.page, a.line_y, string_agg(t.text, ' ' ORDER BY t.x, t.seq) AS text, list(t ORDER BY t.x, t.seq) AS boxes
    FROM items t JOIN anchor_fold a ON a.doc_id = t.doc_id AND a.page = t.page AND a.y = t.y GROUP BY t.doc_id, t.page, a.line_y))"""

QUERIES["items_to_lines"] = lambda s, d: structure.items_to_lines(text_items(s, d)).drop("items")
ORACLES["items_to_lines"] = with_ctes(LINES_SQL, "SELECT doc_id, page, line_no, y, text FROM lines")

QUERIES["items_to_lines_first_fit"] = lambda s, d: structure.items_to_lines(text_items(s, d), "first_fit").drop("items")
ORACLES["items_to_lines_first_fit"] = with_ctes(
    ITEMS_SQL,
    """, ys AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY s) AS i
  FROM (SELECT doc_id, page, y, min(seq) AS s FROM items GROUP BY doc_id, page, y)),
fold AS (
  SELECT doc_id, page, i, y, y AS line_y, [y] AS opened FROM ys WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.i, n.y, coalesce(list_filter(f.opened, lambda l: abs(l - n.y) < 5)[1], n.y),
    CASE WHEN len(list_filter(f.opened, lambda l: abs(l - n.y) < 5)) > 0 THEN f.opened ELSE list_append(f.opened, n.y) END
  FROM fold f JOIN ys n ON n.doc_id = f.doc_id AND n.page = f.page AND n.i = f.i + 1)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_y DESC)::INTEGER AS line_no, line_y AS y, text FROM (
  SELECT t.doc_id, t.page, a.line_y, string_agg(t.text, ' ' ORDER BY t.x, t.seq) AS text
  FROM items t JOIN fold a ON a.doc_id = t.doc_id AND a.page = t.page AND a.y = t.y GROUP BY t.doc_id, t.page, a.line_y)""",
)
