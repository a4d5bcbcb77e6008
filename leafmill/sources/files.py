"""Reading corpora: file routing, content sniffing, inline payloads, catalogues, containers; and the full-text sink."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.blocks import number_rows
from leafmill.functions.text import PAGE_JOINER, clip, let, nonempty, trim_ws

# Fixed values.
TYPE_BY_EXT = {
    ".pdf": "pdf", ".docx": "docx", ".epub": "epub", ".pptx": "pptx", ".xlsx": "xlsx",
    ".txt": "txt", ".md": "txt", ".csv": "txt",
}
OFFICE_MIME = "application/vnd.openxmlformats-officedocument."
TYPE_BY_MIME = {
    "application/pdf": "pdf",
    OFFICE_MIME + "wordprocessingml.document": "docx",
    "application/epub+zip": "epub",
    OFFICE_MIME + "presentationml.presentation": "pptx",
    OFFICE_MIME + "spreadsheetml.sheet": "xlsx",
}
ROUTE_ORDER = ("pdf", "docx", "epub", "pptx", "xlsx")
TEXT_EXTS = (".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm")
SCAN_BYTES = 8192
TRAILER_BYTES = 1024
INLINE_FIELDS = {
    "file": ("fileName", "fileType"),
    "fileData": ("fileName", "fileType"),
    "pdf": ("pdfName", "pdfType"),
    "document": ("documentName", "documentType"),
    "base64": ("fileName", "fileType"),
    "data": ("fileName", "fileType"),
}
EXT_BY_MIME = {
    "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp",
}
BASE64_CHARS = string.ascii_letters + string.digits + "+/"
MIN_INLINE_CHARS = 100
MIN_INLINE_BYTES = 10
PREVIEW_CHARS = 300


# ---- routing --------------------------------------------------------------------------------------------------------


def file_ext(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./]+(\.[^./]*)$", 1))


def file_type(name: Column, mime: Column | None = None, strict: bool = True) -> Column:
    """Type a file is handled as, by extension or MIME, first type in route order wins.

    `strict` rejects unknown files as 'unsupported'; otherwise they are read as plain text.
    """
    ext = file_ext(name)
    kind = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    out = None
    for t in ROUTE_ORDER:
        exts = [e for e, v in TYPE_BY_EXT.items() if v == t]
        mimes = [m for m, v in TYPE_BY_MIME.items() if v == t]
        test = ext.isin(exts) | kind.isin(mimes)
        out = F.when(test, t) if out is None else out.when(test, t)
    text_exts = [e for e, v in TYPE_BY_EXT.items() if v == "txt"] if strict else list(TEXT_EXTS)
    out = out.when(F.startswith(kind, F.lit("text/")) | ext.isin(text_exts), "txt")
    return out.otherwise("unsupported" if strict else "txt")


def read_corpus(spark: SparkSession, path: str, fmt: str = "binary") -> DataFrame:
    """Documents with their `file_type`.

    'binary' lists files without reading their content unless a later step asks for it; 'text' reads whole text files;
    'parquet' reads a table that already has doc_id and text. Files of no bytes are not among Spark's splits and have no row.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "text":
        # the path is a URI here: blanks and other characters are escaped in it, a plus is not
        place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = spark.read.text(path, wholetext=True).select(place.alias("path"), F.col("value").alias("text"))
    elif fmt == "binary":
        rows = spark.read.format("binaryFile").load(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("filename", name).withColumn("file_type", file_type(F.col("filename")))


def sniff_format(blobs: DataFrame, sealed_magic: bytes | None = None) -> DataFrame:
    """(path, kind, pdf_version, header_offset, is_encrypted) from the first and last bytes of each blob."""
    head = F.substring("content", 1, SCAN_BYTES)
    latin = F.decode(head, "ISO-8859-1")
    at = F.instr(latin, "%PDF-")
    magic = lambda n: F.lower(F.hex(F.substring("content", 1, n)))
    kind = F.when(at == 1, "pdf").when(at > 1, "pdf_prefixed")
    kind = kind.when(
        F.startswith(latin, F.lit("JVBERi0")) | F.startswith(latin, F.lit("data:application/pdf;base64,")), "pdf_base64"
    )
    kind = kind.when(magic(4).isin("504b0304", "504b0506", "504b0708"), "zip")
    kind = kind.when(magic(3) == "ffd8ff", "jpeg").when(magic(4) == "89504e47", "png")
    if sealed_magic is not None:
        kind = kind.when((magic(len(sealed_magic)) == sealed_magic.hex()) & (F.length("content") > len(sealed_magic)), "sealed")
    version = F.regexp_extract(F.decode(F.substring("content", 1, 10), "ISO-8859-1"), r"%PDF-(\d+\.\d+)", 1)
    tail = F.decode(F.substring(F.col("content"), F.lit(-TRAILER_BYTES), F.lit(TRAILER_BYTES)), "ISO-8859-1")
    short = F.decode("content", "ISO-8859-1")
    trailer = F.when(F.length("content") <= TRAILER_BYTES, short).otherwise(tail)
    return blobs.select(
        "path",
        kind.otherwise("unknown").alias("kind"),
        nonempty(version, F.lit("unknown")).alias("pdf_version"),
        F.when(at > 0, at - 1).alias("header_offset"),
        F.contains(trailer, F.lit("/Encrypt")).alias("is_encrypted"),
    )


def format_counts(sniffed: DataFrame) -> DataFrame:
    return sniffed.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count_if("is_encrypted").alias("encrypted"))


# ---- inline payloads ------------------------------------------------------------------------------------------------


def decode_base64(c: Column) -> Column:
    """Lenient base64: foreign characters are skipped and missing padding is added.

    The foreign characters are what is left without the alphabet; a pattern for them takes many times as long.
    """
    plain = F.replace(F.replace(c, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))

    def kept(p: Column) -> Column:
        return F.call_function("translate", p, F.translate(p, BASE64_CHARS, ""), F.lit(""))

    def whole(kept: Column) -> Column:
        return F.when(F.length(kept) % 4 == 1, F.substring(kept, F.lit(1), F.length(kept) - 1)).otherwise(kept)

    def padded(w: Column) -> Column:
        return F.rpad(w, (F.ceil(F.length(w) / 4) * 4).cast("int"), "=")

    return F.unbase64(let(let(let(plain, kept), whole), padded))


def once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and new columns that are computed once a row: a later filter on them is not pushed below their computation,
    which would compute them again for the filter, with all they are made of."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


BODY_REJECT = "body is not a JSON object"
EMPTY_REJECT = "no data"
SHORT_REJECT = f"shorter than {MIN_INLINE_CHARS} characters"
ALPHABET_REJECT = "not base64"
BYTES_REJECT = f"fewer than {MIN_INLINE_BYTES} bytes"


def inline_payloads(rows: DataFrame, body: str = "body", key: str = "row_id") -> DataFrame:
    """(row_id, field, item, name, mime, content, reason): everything that known fields of a JSON body offer as a file.

    A field holds a string, an object with uri/data/base64, or an array of either. `reason` says why an offer is no file
    and is null for files; a body that is no JSON object is one row without a field. Fields that are null or empty offer
    nothing. The body is parsed once, for the known fields only, and an object inside it once more.
    """
    known = dict.fromkeys([*INLINE_FIELDS, *(n for names in INLINE_FIELDS.values() for n in names)])
    schema = ", ".join(f"{n} string" for n in known) + ", _bad string"
    parsed = rows.select(key, F.from_json(body, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("_b"))

    def offer(raw: Column, name: Column, mime: Column) -> Column:
        return F.struct(raw.alias("raw"), name.alias("name"), mime.alias("mime"))

    none = F.lit(None).cast("string")
    fields = []
    for field, (name_field, type_field) in INLINE_FIELDS.items():
        value = F.col("_b")[field]
        one = F.array(offer(value, F.col("_b")[name_field], F.col("_b")[type_field]))
        many = F.transform(F.from_json(value, "array<string>"), lambda v: offer(v, none, none))
        items = F.when(F.startswith(value, F.lit("[")), many).when(F.length(value) > 0, one)
        fields.append(F.struct(F.lit(field).alias("field"), items.alias("items")))
    broken = F.col("_b").isNull() | F.col("_b._bad").isNotNull()
    nothing = F.array(F.struct(none.alias("field"), F.array(offer(none, none, none)).alias("items")))
    offers = (
        parsed.select(key, F.explode(F.when(broken, nothing).otherwise(F.array(*fields))).alias("f"))
        .select(key, F.col("f.field").alias("field"), F.posexplode("f.items").alias("item", "v"))
        .withColumn("o", F.when(F.startswith("v.raw", F.lit("{")), F.from_json("v.raw", "uri string, data string, base64 string, name string, type string")))
    )
    boxed = F.startswith("v.raw", F.lit("{"))
    data = F.when(boxed, F.coalesce(*[nonempty(F.col(f"o.{k}"), none) for k in ("uri", "data", "base64")])).otherwise(F.col("v.raw"))
    at = [key, "field", "item"]
    read = once(offers, at, data=data, name=nonempty(F.col("o.name"), F.col("v.name")), given=nonempty(F.col("o.type"), F.col("v.mime")))
    uri = once(read, [*at, "data", "name", "given"], is_uri=F.rlike("data", F.lit(r"^data:([^;]+);base64,(.+)\z")))
    payload = F.when(F.col("is_uri"), F.substring(F.col("data"), F.instr("data", ";base64,") + len(";base64,"), F.length("data"))).otherwise(F.col("data"))
    mime = nonempty(F.when(F.col("is_uri"), F.regexp_extract("data", r"^data:([^;]+);", 1)), nonempty(F.col("given"), F.lit("application/pdf")))
    checked = once(uri, [*at, "name"], mime=mime, payload=payload)
    text_reason = (
        F.when(F.col("field").isNull(), BODY_REJECT)
        .when(F.coalesce(F.length("payload"), F.lit(0)) == 0, EMPTY_REJECT)
        .when(F.length("payload") < MIN_INLINE_CHARS, SHORT_REJECT)
        .when(~F.rlike(clip(F.col("payload"), 200), F.lit(r"^[A-Za-z0-9+/=\r\n]+\z")), ALPHABET_REJECT)
    )
    named = once(checked, [*at, "name", "mime", "payload"], reason=text_reason)
    decoded = once(named, [*at, "name", "mime", "reason"], content=F.when(F.col("reason").isNull(), decode_base64(F.col("payload"))))
    ext = F.coalesce(F.create_map(*[F.lit(v) for kv in EXT_BY_MIME.items() for v in kv])[F.col("mime")], F.lit(""))
    return decoded.select(
        key, "field", F.when(F.col("field").isNotNull(), F.col("item")).alias("item"),
        nonempty(F.col("name"), F.concat(F.lit("upload"), ext)).alias("name"), "mime", "content",
        F.coalesce(F.col("reason"), F.when(F.length("content") < MIN_INLINE_BYTES, BYTES_REJECT)).alias("reason"),
    )


def decode_inline_files(rows: DataFrame, body: str = "body", key: str = "row_id") -> DataFrame:
    """(row_id, field, item, name, mime, content, size): the files that JSON bodies carry as base64 in known fields."""
    files = inline_payloads(rows, body, key).filter(F.col("reason").isNull())
    return files.drop("reason").withColumn("size", F.length("content"))


def inline_rejects(rows: DataFrame, body: str = "body", key: str = "row_id") -> DataFrame:
    """(row_id, field, item, reason): what was offered as a file and is none."""
    return inline_payloads(rows, body, key).filter(F.col("reason").isNotNull()).select(key, "field", "item", "reason")


# ---- catalogue ------------------------------------------------------------------------------------------------------

CATALOGUE_SCHEMA = (
    "id string, title string, type string, template string, fileName string, filePath string, mimeType string, "
    "createdAt string, updatedAt string, fileUrl string, content string"
)


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue of a folder with one JSON file per document."""
    return catalogue_list(spark.read.text(f"{folder}/*.json", wholetext=True))


def catalogue_list(raw: DataFrame) -> DataFrame:
    """Catalogue rows from JSON texts (`value`): unreadable ones are skipped, newest first."""
    parsed = raw.select(F.from_json("value", CATALOGUE_SCHEMA, {"mode": "PERMISSIVE"}).alias("c"))
    return parsed.filter(F.col("c.id").isNotNull()).select("c.*").orderBy(F.desc("createdAt"), "id")


def catalogue_update(catalogue: DataFrame, updates: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(updated catalogue, ids not found): only title, content and template may change, and only when given.

    `updates` has one row per id.
    """
    allowed = ("title", "content", "template")
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in allowed], F.lit(True).alias("_hit"))
    joined = catalogue.join(new, "id", "left")
    for c in allowed:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    joined = joined.withColumn("updatedAt", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updatedAt")))
    missing = updates.join(catalogue.select("id"), "id", "left_anti").select("id", F.lit("Document not found").alias("error"))
    return joined.select(*catalogue.columns), missing


# ---- unzipped containers --------------------------------------------------------------------------------------------

SLIDE_ENTRY = r"^ppt/slides/slide(\d+)\.xml$"
SHEET_ENTRY = r"^xl/worksheets/sheet\d*\.xml$"
SHARED_STRINGS = "xl/sharedStrings.xml"
NO_SHEET_TEXT = "(No text content found in spreadsheet)"
NO_SLIDE_TEXT = "(No text found in slides)"


def slide_texts(parts: DataFrame, numeric_order: bool = False) -> DataFrame:
    """(doc_id, slide, text) from parts (doc_id, entry, xml); entries sort as strings unless `numeric_order`."""
    number = F.regexp_extract("entry", SLIDE_ENTRY, 1)
    runs = F.regexp_extract_all(F.col("xml"), F.lit(r"<a:t[^>]*>([^<]+)</a:t>"), F.lit(1))
    words = F.filter(F.transform(runs, trim_ws), lambda t: F.length(t) > 0)
    slides = parts.filter(F.rlike("entry", F.lit(SLIDE_ENTRY))).select(
        "doc_id", number.alias("number"), F.array_join(words, " ").alias("words")
    )
    if numeric_order:
        slides = slides.withColumn("number", F.lpad("number", 12, "0"))
        block = F.substring("number", 1, 10)
    else:
        block = F.rpad(F.substring("number", 1, 4), 4, " ")
    return number_rows(slides, ["doc_id"], ["number"], block, "slide").select(
        "doc_id", "slide", F.concat(F.lit("[Slide "), F.col("slide").cast("string"), F.lit("]\n"), F.col("words")).alias("text")
    )


def container_text(parts: DataFrame, kind: str, numeric_order: bool = False) -> DataFrame:
    """(doc_id, raw_text) of unzipped presentations ('pptx') or spreadsheets ('xlsx'): one text cell per container."""
    docs = parts.select("doc_id").distinct()
    if kind == "pptx":
        texts = slide_texts(parts, numeric_order).groupBy("doc_id").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("slide", "text"))).getField("text"), PAGE_JOINER).alias("raw_text")
        )
        default = NO_SLIDE_TEXT
    else:
        shared = F.col("entry") == SHARED_STRINGS
        sheet = F.rlike("entry", F.lit(SHEET_ENTRY))
        strings = F.regexp_extract_all(F.col("xml"), F.lit(r"<t[^>]*>([^<]*)</t>"), F.lit(1))
        inline = F.regexp_extract_all(F.col("xml"), F.lit(r"<is>[\s\S]*?<t[^>]*>([^<]+)</t>[\s\S]*?</is>"), F.lit(1))
        values = F.filter(F.when(shared, strings).otherwise(inline), lambda t: F.length(trim_ws(t)) > 0)
        rows = parts.filter(shared | sheet).select("doc_id", (~shared).alias("late"), "pos", values.alias("values"))
        ordered = F.sort_array(F.collect_list(F.struct("late", "pos", "values")))
        texts = rows.groupBy("doc_id").agg(F.array_join(F.flatten(ordered.getField("values")), " ").alias("raw_text"))
        default = NO_SHEET_TEXT
    return docs.join(texts, "doc_id", "left").select("doc_id", nonempty(F.col("raw_text"), F.lit(default)).alias("raw_text"))


OPF_ITEM = r'(?i)<item\s[^>]*?id\s*=\s*"([^"]*)"[^>]*?href\s*=\s*"([^"]*)"[^>]*?>'
OPF_ITEMREF = r'(?i)<itemref\s[^>]*?idref\s*=\s*"([^"]*)"'


def epub_spine(opf: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, pos, href, html, listed): parts in reading order.

    `opf` has (doc_id, opf_dir, opf), `parts` (doc_id, pos, entry, body). Manifest and spine meet in an equi join on
    (doc_id, id), then the parts on (doc_id, entry). A book without spine gives all its HTML parts in archive order,
    with `listed` false.
    """
    ids = F.regexp_extract_all(F.col("opf"), F.lit(OPF_ITEM), F.lit(1))
    hrefs = F.regexp_extract_all(F.col("opf"), F.lit(OPF_ITEM), F.lit(2))
    prefix = F.when(F.length("opf_dir") > 0, F.concat("opf_dir", F.lit("/"))).otherwise("")
    manifest = (
        opf.select("doc_id", prefix.alias("prefix"), F.posexplode(F.arrays_zip(ids.alias("id"), hrefs.alias("href"))).alias("n", "m"))
        .groupBy("doc_id", F.col("m.id").alias("id"))
        .agg(F.max_by(F.concat("prefix", "m.href"), "n").alias("href"))
        .filter(F.length("href") > 0)
    )
    spine = opf.select(
        "doc_id", F.posexplode(F.regexp_extract_all(F.col("opf"), F.lit(OPF_ITEMREF), F.lit(1))).alias("pos", "id")
    ).join(manifest, ["doc_id", "id"])
    path = F.try_url_decode(F.replace(F.substring_index("href", "#", 1), F.lit("+"), F.lit("%2B")))
    bodies = parts.select("doc_id", F.col("entry").alias("href"), F.col("body").alias("html"))
    listed = spine.select("doc_id", "pos", path.alias("href")).join(bodies, ["doc_id", "href"]).select(
        "doc_id", "pos", "href", "html", F.lit(True).alias("listed")
    )
    unlisted = (
        parts.filter(F.rlike("entry", F.lit(r"\.(html|xhtml|htm)$")))
        .join(spine.select("doc_id").distinct(), "doc_id", "left_anti")
        .select("doc_id", "pos", F.col("entry").alias("href"), F.col("body").alias("html"), F.lit(False).alias("listed"))
    )
    return listed.unionByName(unlisted)


def epub_chapters(opf: DataFrame, parts: DataFrame, title_chars: int | None = None) -> DataFrame:
    """(doc_id, page, title, text): chapters in spine order, or the numbered sections of a book without spine.

    Titles are whole, or their first `title_chars` characters.
    """
    from leafmill.functions.blocks import block_of
    from leafmill.operators.structure import html_chapters, plain_html

    ordered = epub_spine(opf, parts)
    chapters = html_chapters(ordered.filter("listed").select("doc_id", "pos", "html"), title_chars).select(
        "doc_id", "page", F.col("chapter_title").alias("title"), "text"
    )
    sections = number_rows(ordered.filter("not listed"), ["doc_id"], ["pos"], block_of("pos"), "page").select(
        "doc_id", "page", F.concat(F.lit("Section "), F.col("page").cast("string")).alias("title"), plain_html(F.col("html")).alias("text")
    )
    return chapters.unionByName(sections.filter(F.length("text") > 0))


# ---- sink -----------------------------------------------------------------------------------------------------------


def fulltext(pages: DataFrame, pages_per_part: int = 4096) -> DataFrame:
    """(doc_id, part, full_text, preview): anchored page blocks in page order.

    A part holds the pages of one page-number range, so no task ever builds an unbounded text; ordinary documents have
    part 0 only. The preview is the start of the first page.
    """
    part = F.floor((F.col("page") - 1) / pages_per_part).cast("int")
    block = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("page", "block")))
    return (
        pages.select("doc_id", "page", part.alias("part"), block.alias("block"), clip(F.col("text"), PREVIEW_CHARS).alias("start"))
        .groupBy("doc_id", "part")
        .agg(F.array_join(ordered.getField("block"), PAGE_JOINER).alias("full_text"), F.min_by("start", "page").alias("preview"))
        .withColumn("preview", F.when(F.col("part") == 0, F.col("preview")))
    )


def write_fulltext(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    fulltext(pages).write.mode(mode).parquet(path)
