"""Registered queries: file routing, sniffing, inline payloads, catalogues, containers, full text, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.plans import inputs as i
from leafmill.plans.grounding_queries import pick, pick_sql
from leafmill.plans.inputs import trim_sql, with_ctes
from leafmill.plans.structure_queries import HTML_PAGES_SQL, html_pages, plain_sql
from leafmill.sources import files, retention
from leafmill.session import table

QUERIES = {}
ORACLES = {}


# ---- routing and sniffing -------------------------------------------------------------------------------------------

NAMES = ["a.PDF", "b.docx", "c.tar.gz", "d", "e.pptx", "f.csv", ".md", "g.epub", "h.xlsx"]
MIMES = [None, "application/pdf", "text/html", "image/png", "APPLICATION/EPUB+ZIP"]
_KINDS = {"a.PDF": "pdf", "b.docx": "docx", "e.pptx": "pptx", "f.csv": "txt", "g.epub": "epub", "h.xlsx": "xlsx"}


def _routed(s, d):
    name, mime = pick(NAMES, F.col("doc_id")), pick(MIMES, F.col("doc_id"))
    return i.documents(s, d).select(
        "doc_id", name.alias("filename"), files.file_type(name, mime).alias("file_type"), files.file_type(name, mime, strict=False).alias("read_as")
    )


def _route_sql(default: str) -> str:
    order = ["pdf", "docx", "epub", "pptx", "xlsx"]
    cases = []
    for kind in order:
        name = next(n for n, k in _KINDS.items() if k == kind)
        mime = {"pdf": "application/pdf", "epub": "application/epub+zip"}.get(kind)
        cases.append(f"WHEN name = '{name}'" + (f" OR lower(mime) = '{mime}'" if mime else "") + f" THEN '{kind}'")
    return f"CASE {' '.join(cases)} WHEN mime = 'text/html' OR name = 'f.csv' THEN 'txt' ELSE '{default}' END"


QUERIES["read_corpus_routes"] = _routed
ORACLES["read_corpus_routes"] = f"""SELECT doc_id, name AS filename, {_route_sql('unsupported')} AS file_type, {_route_sql('txt')} AS read_as
FROM (SELECT doc_id, {pick_sql(NAMES, 'doc_id')} AS name, {pick_sql(MIMES, 'doc_id')} AS mime FROM documents)"""


def blobs(s, d) -> DataFrame:
    """Document texts as byte blobs with eight kinds of heads; every sixth has an encryption mark near its end."""
    text = F.col("text").cast("binary")
    k = F.col("doc_id") % 8
    b = lambda x: F.unhex(F.lit(x.hex()))
    head = (
        F.when(k == 0, b(b"%PDF-1.7\n")).when(k == 1, b(b"\xef\xbb\xbf\n%PDF-2.0\n")).when(k == 2, b(b"JVBERi0xLjQK"))
        .when(k == 3, b(b"PK\x03\x04")).when(k == 4, b(b"\xff\xd8\xff\xe0")).when(k == 5, b(b"\x89PNG\r\n")).when(k == 6, b(b"SEALED1")).otherwise(b(b""))
    )
    tail = F.when(F.col("doc_id") % 6 == 0, b(b"/Encrypt 5 0 R" + b" " * 1000)).when(F.col("doc_id") % 6 == 1, b(b"/Encrypt" + b" " * 1020)).otherwise(b(b""))
    return i.documents(s, d).select(F.col("doc_id").cast("string").alias("path"), F.concat(head, text, tail).alias("content"))


_SNIFF_SQL = """sniffed AS (
  SELECT doc_id::VARCHAR AS path, CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf_prefixed' WHEN 2 THEN 'pdf_base64' WHEN 3 THEN 'zip'
      WHEN 4 THEN 'jpeg' WHEN 5 THEN 'png' WHEN 6 THEN 'sealed' ELSE 'unknown' END AS kind,
    CASE doc_id % 8 WHEN 0 THEN '1.7' ELSE 'unknown' END AS pdf_version, CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 4 END AS header_offset,
    doc_id % 6 = 0 AS is_encrypted FROM documents)"""
QUERIES["sniff_format"] = lambda s, d: files.sniff_format(blobs(s, d), sealed_magic=b"SEALED1")
ORACLES["sniff_format"] = with_ctes(_SNIFF_SQL, "SELECT * FROM sniffed")
QUERIES["format_counts"] = lambda s, d: files.format_counts(files.sniff_format(blobs(s, d), sealed_magic=b"SEALED1"))
ORACLES["format_counts"] = with_ctes(
    _SNIFF_SQL, "SELECT kind, count(*) AS files, count(*) FILTER (WHERE is_encrypted) AS encrypted FROM sniffed GROUP BY kind"
)


# ---- inline payloads ------------------------------------------------------------------------------------------------


def bodies(s, d) -> DataFrame:
    """Request bodies that carry the document's text as base64 in one of five ways."""
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    uri = F.concat(F.lit("data:image/png;base64,"), b64)
    k = F.col("doc_id") % 5
    n = F.col("doc_id").cast("string")
    body = (
        F.when(k == 0, F.to_json(F.struct(b64.alias("file"), F.concat(F.lit("n"), n).alias("fileName"))))
        .when(k == 1, F.to_json(F.struct(F.struct(uri.alias("uri"), F.lit("o.png").alias("name")).alias("document"), F.lit("text/plain").alias("documentType"))))
        .when(k == 2, F.concat(F.lit('{"pdf":["'), b64, F.lit('",{"data":"'), uri, F.lit('","type":"image/gif"},"tiny"]}')))
        .when(k == 3, F.to_json(F.struct(F.concat(F.lit("***"), b64).alias("data"), b64.alias("base64"), F.lit("image/webp").alias("fileType"))))
        .otherwise(F.lit("not json"))
    )
    return i.documents(s, d).select(F.col("doc_id").alias("row_id"), body.alias("body"))


def _inline(s, d):
    out = files.decode_inline_files(bodies(s, d))
    return out.select("row_id", "field", "item", "name", "mime", "size", F.md5("content").alias("digest"))


QUERIES["decode_inline_files"] = _inline
ORACLES["decode_inline_files"] = """WITH src AS (
  SELECT doc_id AS row_id, doc_id % 5 AS k, strlen(text)::INTEGER AS size, md5(text) AS digest FROM documents WHERE length(base64(encode(text))) >= 100)
SELECT row_id, 'file' AS field, 0 AS item, 'n' || row_id AS name, 'application/pdf' AS mime, size, digest FROM src WHERE k = 0
UNION ALL SELECT row_id, 'document', 0, 'o.png', 'image/png', size, digest FROM src WHERE k = 1
UNION ALL SELECT row_id, 'pdf', 0, 'upload.pdf', 'application/pdf', size, digest FROM src WHERE k = 2
UNION ALL SELECT row_id, 'pdf', 1, 'upload.png', 'image/png', size, digest FROM src WHERE k = 2
UNION ALL SELECT row_id, 'base64', 0, 'upload.webp', 'image/webp', size, digest FROM src WHERE k = 3"""


QUERIES["inline_rejects"] = lambda s, d: files.inline_rejects(bodies(s, d))
ORACLES["inline_rejects"] = """WITH src AS (
  SELECT doc_id AS row_id, doc_id % 5 AS k, text IS NULL AS missing, coalesce(length(base64(encode(text))), 0) AS n FROM documents),
few AS (SELECT * FROM src WHERE n < 100)
SELECT row_id, 'file' AS field, 0 AS item, 'shorter than 100 characters' AS reason FROM few WHERE k = 0 AND n > 0
UNION ALL SELECT row_id, 'document', 0, CASE WHEN missing THEN 'no data' ELSE 'shorter than 100 characters' END FROM few WHERE k = 1
UNION ALL SELECT row_id, 'pdf', 0, CASE WHEN n = 0 THEN 'no data' ELSE 'shorter than 100 characters' END FROM few WHERE k = 2 AND NOT missing
UNION ALL SELECT row_id, 'pdf', 1, 'shorter than 100 characters' FROM few WHERE k = 2 AND NOT missing
UNION ALL SELECT row_id, 'pdf', 2, 'shorter than 100 characters' FROM src WHERE k = 2 AND NOT missing
UNION ALL SELECT row_id, 'data', 0, CASE WHEN n < 97 THEN 'shorter than 100 characters' ELSE 'not base64' END FROM src WHERE k = 3 AND NOT missing
UNION ALL SELECT row_id, 'base64', 0, 'shorter than 100 characters' FROM few WHERE k = 3 AND n > 0
UNION ALL SELECT row_id, NULL, NULL, 'body is not a JSON object' FROM src WHERE k = 4 OR (k = 2 AND missing)"""


# ---- catalogue ------------------------------------------------------------------------------------------------------


def catalogue_json(s, d) -> DataFrame:
    """One JSON text per document; every tenth is cut off in the middle."""
    n = F.col("doc_id").cast("string")
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))
    text = F.to_json(
        F.struct(
            n.alias("id"), F.concat("source", F.lit(" "), "lang").alias("title"), F.lit("word").alias("type"), F.lit("blank").alias("template"),
            stamp.alias("createdAt"), stamp.alias("updatedAt"), F.concat(F.lit("/api/file/"), n).alias("fileUrl"),
        )
    )
    broken = F.when(F.col("doc_id") % 10 == 3, F.substring(text, 1, 5)).otherwise(text)
    return i.documents(s, d).select(broken.alias("value"))


_CAT_SQL = """cat AS (
  SELECT doc_id::VARCHAR AS id, source || ' ' || lang AS title, 'word' AS type, 'blank' AS template,
    '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00.000Z' AS createdAt FROM documents WHERE doc_id % 10 <> 3)"""


def _ranked_catalogue(s, d):
    from pyspark.sql import Window

    listed = files.catalogue_list(catalogue_json(s, d))
    # numbering 28 days' worth of documents per day shows the order
    per_day = Window.partitionBy("createdAt").orderBy("id")
    return listed.select("id", "title", "createdAt", F.row_number().over(per_day).alias("n"))


QUERIES["catalogue_list"] = _ranked_catalogue
ORACLES["catalogue_list"] = with_ctes(
    _CAT_SQL, "SELECT id, title, createdAt, (row_number() OVER (PARTITION BY createdAt ORDER BY id))::INTEGER AS n FROM cat"
)


def _updated(s, d):
    updates = i.documents(s, d).filter("doc_id % 4 <> 1").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("new "), "lang")).alias("title"),
        F.when(F.col("doc_id") % 4 == 2, F.substring("text", 1, 10)).alias("content"),
        F.lit(None).cast("string").alias("template"),
    )
    return files.catalogue_update(files.catalogue_list(catalogue_json(s, d)), updates, "2025-06-01T00:00:00.000Z")


QUERIES["catalogue_update"] = lambda s, d: _updated(s, d)[0].select("id", "title", "template", "content", "updatedAt")
ORACLES["catalogue_update"] = with_ctes(
    _CAT_SQL,
    """SELECT c.id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || lang ELSE title END AS title, template, CASE WHEN doc_id % 4 = 2 THEN substring(text, 1, 10) END AS content,
  CASE WHEN doc_id % 4 <> 1 THEN '2025-06-01T00:00:00.000Z' ELSE createdAt END AS updatedAt FROM cat c JOIN documents d ON d.doc_id::VARCHAR = c.id""",
)
QUERIES["catalogue_update_missing"] = lambda s, d: _updated(s, d)[1]
ORACLES["catalogue_update_missing"] = "SELECT doc_id::VARCHAR AS id, 'Document not found' AS error FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 10 = 3"


# ---- containers -----------------------------------------------------------------------------------------------------


def deck_parts(s, d) -> DataFrame:
    """Each document's lines as slides of a presentation, each run a word pair; some documents have no slides."""
    lines = i.documents(s, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    n = (F.col("k") * 3 + 1).cast("string")
    entry = F.when(F.col("lang") == "es", F.concat(F.lit("ppt/media/x"), n)).otherwise(F.concat(F.lit("ppt/slides/slide"), n, F.lit(".xml")))
    xml = F.concat(F.lit("<p><a:t>"), F.replace("line", F.lit(" "), F.lit("</a:t><a:t xml:space=\"preserve\"> </a:t><a:t> ")), F.lit("</a:t></p>"))
    return lines.select("doc_id", F.col("k").alias("pos"), entry.alias("entry"), xml.alias("xml"))


QUERIES["container_text_slides"] = lambda s, d: files.container_text(deck_parts(s, d), "pptx")
_LINES = """doc_line AS (SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))"""
ORACLES["container_text_slides"] = with_ctes(
    _LINES,
    f""", slides AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY (k * 3 + 1)::VARCHAR) AS n,
    array_to_string(list_filter(list_transform(string_split(line, ' '), lambda w: {trim_sql('w')}), lambda w: w <> ''), ' ') AS t FROM doc_line WHERE lang <> 'es')
SELECT doc_id, coalesce(string_agg('[Slide ' || n || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY n), '(No text found in slides)') AS raw_text
FROM documents LEFT JOIN slides USING (doc_id) GROUP BY doc_id""",
)


def sheet_parts(s, d) -> DataFrame:
    """Even lines are shared strings, odd lines an inline string of their own sheet."""
    lines = i.documents(s, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("k", "line")).filter("lang <> 'fr'")
    shared = (
        lines.filter("k % 2 = 0").groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("ls"))
        .select("doc_id", F.lit(900).alias("pos"), F.lit("xl/sharedStrings.xml").alias("entry"),
                F.concat(F.lit("<sst><si><t> </t></si>"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("<si><t>"), x["line"], F.lit("</t></si>"))), ""), F.lit("</sst>")).alias("xml"))
    )
    inline = lines.filter("k % 2 = 1").select(
        "doc_id", F.col("k").alias("pos"), F.concat(F.lit("xl/worksheets/sheet"), F.col("k").cast("string"), F.lit(".xml")).alias("entry"),
        F.concat(F.lit("<c><v>1</v></c><is><t a='b'>"), F.col("line"), F.lit("</t></is>")).alias("xml"),
    )
    other = i.documents(s, d).select("doc_id", F.lit(0).alias("pos"), F.lit("docProps/app.xml").alias("entry"), F.lit("<t>no</t>").alias("xml"))
    return shared.unionByName(inline).unionByName(other)


QUERIES["container_text_sheets"] = lambda s, d: files.container_text(sheet_parts(s, d), "xlsx")
ORACLES["container_text_sheets"] = with_ctes(
    _LINES,
    f"""SELECT doc_id, coalesce(string_agg(line, ' ' ORDER BY k % 2, k) FILTER (WHERE lang <> 'fr' AND {trim_sql('line')} <> ''), '(No text content found in spreadsheet)') AS raw_text
FROM doc_line GROUP BY doc_id""",
)


def _epub(s, d):
    """Each web page as a book of two parts; every fifth book has no spine."""
    pages = html_pages(s, d)
    half = F.floor(F.length("html") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("OEBPS/a b.html").alias("entry"), F.substring(F.col("html"), F.lit(1), half).alias("body")),
        F.struct(F.lit(1).alias("pos"), F.lit("OEBPS/c.xhtml").alias("entry"), F.substring(F.col("html"), half + 1, F.length("html")).alias("body")),
        F.struct(F.lit(2).alias("pos"), F.lit("OEBPS/cover.jpg").alias("entry"), F.lit("jpeg").alias("body")),
    )
    manifest = '<manifest><item id="x" href="old.html"/><item  id="x" media-type="t" href="a%20b.html#top"/><item id="y" href="c.xhtml"/><item id="z" href="gone.html"/></manifest>'
    spine = '<spine><itemref idref="y"/><itemref linear="no" idref="nope"/><itemref idref="x" /><itemref idref="z"/></spine>'
    opf = pages.select(
        F.col("page_id").alias("doc_id"), F.lit("OEBPS").alias("opf_dir"),
        F.concat(F.lit(manifest), F.when(F.col("page_id") % 5 == 0, "").otherwise(spine)).alias("opf"),
    )
    return opf, pages.select(F.col("page_id").alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.*")


_EPUB_SQL = HTML_PAGES_SQL + """,
part AS (
  SELECT page_id AS doc_id, 0 AS pos, 'OEBPS/a b.html' AS href, substring(html, 1, length(html) // 2) AS html FROM html_pages
  UNION ALL SELECT page_id, 1, 'OEBPS/c.xhtml', substring(html, length(html) // 2 + 1) FROM html_pages),
spine AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN pos WHEN pos = 1 THEN 0 ELSE 2 END AS pos, href, html, doc_id % 5 <> 0 AS listed FROM part)"""
QUERIES["epub_spine"] = lambda s, d: files.epub_spine(*_epub(s, d))
ORACLES["epub_spine"] = with_ctes(_EPUB_SQL, "SELECT * FROM spine")
QUERIES["epub_chapters_limited"] = lambda s, d: files.epub_chapters(*_epub(s, d), 100)
ORACLES["epub_chapters_limited"] = with_ctes(
    _EPUB_SQL,
    f""", read AS (
  SELECT doc_id, pos, listed, {plain_sql('html')} AS text, CASE WHEN regexp_matches(html, '(?i)<h[1-3][^>]*>[\\s\\S]*?</h[1-3]>')
    THEN substring({plain_sql("regexp_extract(html, '(?i)<h[1-3][^>]*>([\\s\\S]*?)</h[1-3]>', 1)")}, 1, 100) END AS title FROM spine),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INTEGER AS page FROM read WHERE length(text) >= 5 OR NOT listed)
SELECT doc_id, page, CASE WHEN listed THEN coalesce(title, 'Chapter ' || page) ELSE 'Section ' || page END AS title, text FROM numbered WHERE text <> ''""",
)
QUERIES["epub_chapters"] = lambda s, d: files.epub_chapters(*_epub(s, d))
ORACLES["epub_chapters"] = ORACLES["epub_chapters_limited"].replace(", 1, 100) END AS title", ", 1) END AS title")


# ---- sink and retention ---------------------------------------------------------------------------------------------

QUERIES["fulltext"] = lambda s, d: files.fulltext(i.book_pages(s, d), 300)
ORACLES["fulltext"] = with_ctes(
    i.book_pages_sql(),
    """SELECT doc_id, ((page - 1) // 300)::INTEGER AS part, string_agg('[Page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS full_text,
  CASE WHEN (page - 1) // 300 = 0 THEN substring(arg_min(text, page), 1, 300) END AS preview
FROM book_pages GROUP BY doc_id, (page - 1) // 300""",
)

QUERIES["retention_sweep"] = lambda s, d: retention.retention_sweep(
    table(s, d, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("modified"), "user_id"),
    F.lit("2024-01-15 12:00:00").cast("timestamp"),
).select("path", "user_id")
ORACLES["retention_sweep"] = "SELECT event_id::VARCHAR AS path, user_id FROM events WHERE ts < TIMESTAMP '2024-01-15 11:00:00'"
QUERIES["retention_survivors"] = lambda s, d: retention.survivors(
    table(s, d, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("modified")),
    F.lit("2024-01-15 12:00:00").cast("timestamp"),
).select("path")
ORACLES["retention_survivors"] = "SELECT event_id::VARCHAR AS path FROM events WHERE ts >= TIMESTAMP '2024-01-15 11:00:00'"
