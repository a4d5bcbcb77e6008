"""Inputs the registered queries share: every one is derived by Spark from the given tables, whole.

Each `*_sql` twin builds the same input in the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import WS, WS_CHARS
from leafmill.operators.chunking import chunk_pages
from leafmill.operators.pagination import paginate_fixed
from leafmill.session import stage_table, table

SMALL_PAGE = 400
SMALL_CHUNK = 900


# ---- SQL spelling helpers -------------------------------------------------------------------------------------------

WS_SQL = f"'{WS_CHARS}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def squeeze_sql(expr: str) -> str:
    return trim_sql(f"regexp_replace({expr}, {q(WS + '+')}, ' ', 'g')")


def with_ctes(ctes: str | list[str], select: str) -> str:
    body = ctes if isinstance(ctes, str) else ",\n".join(ctes)
    return f"WITH RECURSIVE {body}\n{select}"


# ---- pages ----------------------------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_pages(spark: SparkSession, sf_dir: str, size: int = 2000) -> DataFrame:
    """Documents cut into synthetic pages."""
    return paginate_fixed(documents(spark, sf_dir), size)


def doc_pages_sql(name: str = "doc_pages", size: int = 2000) -> str:
    return f"""{name} AS (
  SELECT doc_id, p::INTEGER AS page, substring(text, (p - 1) * {size} + 1, {size}) AS text, false AS was_ocr,
         length(substring(text, (p - 1) * {size} + 1, {size}))::INTEGER AS char_count
  FROM (SELECT doc_id, coalesce(text, '') AS text,
               unnest(range(1, greatest(ceil(length(coalesce(text, '')) / {size}.0)::BIGINT, 1) + 1)) AS p
        FROM documents))"""


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as one long document whose pages carry furniture, hyphen breaks and blank lines."""
    page = (F.col("doc_id") + 1).cast("int")
    body = F.replace(F.replace("text", F.lit("tion "), F.lit("ti-\non ")), F.lit(".\n"), F.lit(".\n\n\n"))
    text = F.concat(
        F.lit("ACME "), F.col("source"), F.lit("\n"), body, F.lit("\n- "), page.cast("string"), F.lit(" -")
    )
    return documents(spark, sf_dir).select(F.col("source").alias("doc_id"), page.alias("page"), text.alias("text"))


def book_pages_sql(name: str = "book_pages") -> str:
    return f"""{name} AS (
  SELECT source AS doc_id, (doc_id + 1)::INTEGER AS page,
         'ACME ' || source || chr(10) || replace(replace(text, 'tion ', 'ti-' || chr(10) || 'on '),
           '.' || chr(10), '.' || chr(10) || chr(10) || chr(10)) || chr(10) || '- ' || (doc_id + 1) || ' -' AS text
  FROM documents)"""


# ---- chunks ---------------------------------------------------------------------------------------------------------


def small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short chunks, so that most documents have several; stored once, as an ingest does, for the queries on them."""
    return stage_table(chunk_pages(doc_pages(spark, sf_dir, SMALL_PAGE), SMALL_CHUNK))


def chunks_sql(pages: str, max_chars: int, name: str = "chunks") -> str:
    """Greedy page packing as a recursive query over the pages of each document, one page per step."""
    p = f"{name}_"
    return f"""{p}inked AS (
  SELECT doc_id, page, text, '[Page ' || page || ']' || chr(10) || text AS blk,
         row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i
  FROM {pages} WHERE length({trim_sql('text')}) > 0),
{p}fold AS (
  SELECT doc_id, i, CASE WHEN length(blk) > {max_chars} THEN 0 ELSE length(blk) END AS cur, 1 AS seg
  FROM {p}inked WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i,
         CASE WHEN length(n.blk) > {max_chars} THEN 0
              WHEN f.cur = 0 OR f.cur + length(n.blk) > {max_chars} THEN length(n.blk)
              ELSE f.cur + 2 + length(n.blk) END,
         f.seg + CASE WHEN length(n.blk) > {max_chars} OR f.cur = 0 OR f.cur + length(n.blk) > {max_chars}
                      THEN 1 ELSE 0 END
  FROM {p}fold f JOIN {p}inked n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
{p}paras AS (
  SELECT doc_id, page, i, unnest(ps) AS para, generate_subscripts(ps, 1) AS k
  FROM (SELECT doc_id, page, i, regexp_split_to_array(text, '\\n{{2,}}') AS ps
        FROM {p}inked WHERE length(blk) > {max_chars})),
{p}cut AS (
  SELECT doc_id, page, i, 0::BIGINT AS k, 0 AS sub, length('[Page ' || page || ']') + 1 AS cur
  FROM {p}inked WHERE length(blk) > {max_chars}
  UNION ALL
  SELECT c.doc_id, c.page, c.i, t.k::BIGINT,
         c.sub + CASE WHEN c.cur + length(t.para) > {max_chars} AND c.cur > 20 THEN 1 ELSE 0 END,
         CASE WHEN c.cur + length(t.para) > {max_chars} AND c.cur > 20
              THEN length('[Page ' || c.page || ' continued]') + 1 ELSE c.cur END + length(t.para) + 2
  FROM {p}cut c JOIN {p}paras t ON t.doc_id = c.doc_id AND t.page = c.page AND t.k = c.k + 1),
{p}subs AS (
  SELECT c.doc_id, c.page, c.i, c.sub,
         {trim_sql(f"CASE WHEN c.sub = 0 THEN '[Page ' || c.page || ']' ELSE '[Page ' || c.page || ' continued]' END || chr(10) || coalesce(string_agg(t.para || chr(10) || chr(10), '' ORDER BY c.k), '')")} AS text
  FROM {p}cut c LEFT JOIN {p}paras t ON t.doc_id = c.doc_id AND t.page = c.page AND t.k = c.k
  GROUP BY c.doc_id, c.page, c.i, c.sub),
{p}packed AS (
  SELECT f.doc_id, f.seg, 0 AS sub,
         {trim_sql("string_agg(n.blk, chr(10) || chr(10) ORDER BY n.i)")} AS text, list(n.page ORDER BY n.i) AS pages
  FROM {p}fold f JOIN {p}inked n ON n.doc_id = f.doc_id AND n.i = f.i
  WHERE length(n.blk) <= {max_chars} GROUP BY f.doc_id, f.seg
  UNION ALL
  SELECT s.doc_id, f.seg, s.sub, s.text, [s.page] FROM {p}subs s JOIN {p}fold f ON f.doc_id = s.doc_id AND f.i = s.i),
{name} AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg, sub) - 1)::INTEGER AS chunk_id, text, pages
  FROM {p}packed)"""


def small_chunks_sql(name: str = "chunks") -> str:
    return doc_pages_sql("small_pages", SMALL_PAGE) + ",\n" + chunks_sql("small_pages", SMALL_CHUNK, name)


def tokens_sql(expr: str) -> str:
    plain = f"regexp_replace(lower({expr}), {q('[^a-z0-9' + WS[1:])}, '', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, {q(WS + '+')}), lambda w: length(w) > 2)"
