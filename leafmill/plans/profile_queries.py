"""Registered queries: annotations, forms, document profiles, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import citations, profiling
from leafmill.plans import inputs as i
from leafmill.plans.grounding_queries import pick, pick_sql
from leafmill.plans.inputs import q, trim_sql, with_ctes
from leafmill.session import table

QUERIES = {}
ORACLES = {}


# ---- annotations ----------------------------------------------------------------------------------------------------

COLORS = [[1.0, 1.0, 0.0], [0.0, 0.8, 0.1], [0.2, 0.5, 0.9], [1.0, 0.5, 0.7], [1.0, 0.0, 0.0], [0.9, 0.5, 0.0], [0.5, 0.5, 0.5], []]
COLOR_NAMES = ["yellow", "green", "blue", "pink", "red", "orange", "custom", "unknown"]
AUTHORS = ["ann", "bob", None, "Cy", ""]


def annotations(s, d) -> DataFrame:
    """Every event as an annotation in its user's document."""
    e = F.col("event_id")
    color = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]).cast("array<double>") for c in COLORS]), (e % 8 + 1).cast("int"))
    kind = F.create_map(*[F.lit(x) for x in ("click", "Highlight", "view", "Text", "purchase", "FreeText", "error", "Link", "signup", "Underline")])
    return table(s, d, "events").select(
        F.col("user_id").alias("doc_id"),
        (e % 7 + 1).cast("int").alias("page"),
        e.alias("seq"),
        kind[F.col("event_type")].alias("type"),
        F.when(e % 3 == 0, F.col("props")).alias("contents"),
        F.when(e % 5 == 0, F.concat(F.lit("<p> rich <b>"), e.cast("string"), F.lit("</b></p>"))).when(e % 5 == 1, "<p> </p>").alias("rich"),
        pick(AUTHORS, e).alias("author"),
        color.alias("color"),
        F.date_format("ts", "'D:'yyyyMMddHHmmss").alias("date"),
    )


ANNOTATIONS_SQL = f"""ann AS (
  SELECT user_id AS doc_id, (event_id % 7 + 1)::INTEGER AS page, event_id AS seq, type, ts,
    CASE WHEN event_id % 5 = 0 THEN 'rich ' || event_id WHEN event_id % 3 = 0 THEN props ELSE '[' || type || ' annotation]' END AS text,
    CASE WHEN type IN ('Text', 'FreeText') AND event_id % 3 = 0 THEN props ELSE '' END AS note,
    coalesce({pick_sql(AUTHORS, 'event_id')}, 'Unknown') AS author, {pick_sql(COLOR_NAMES, 'event_id')} AS color_name
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'Highlight' WHEN 'view' THEN 'Text' WHEN 'purchase' THEN 'FreeText' WHEN 'signup' THEN 'Underline' ELSE 'Link' END AS type FROM events)
  WHERE type <> 'Link')"""

QUERIES["annotation_table"] = lambda s, d: profiling.annotation_table(annotations(s, d)).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
ORACLES["annotation_table"] = with_ctes(
    ANNOTATIONS_SQL,
    "SELECT doc_id, page, seq, type, text, note, author, color_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date FROM ann",
)

_LABELS = {"page": "'Page ' || page", "color": "color_name", "author": "CASE author WHEN '' THEN 'Unknown Author' ELSE author END"}
for _by, _label in _LABELS.items():
    QUERIES[f"group_annotations_{_by}"] = lambda s, d, by=_by: profiling.group_annotations(annotations(s, d), by).select(
        "doc_id", "label", "part",
        F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["page"].cast("string"), x["type"], x["text"], x["color_name"])), "|").alias("items"),
    )
    ORACLES[f"group_annotations_{_by}"] = with_ctes(
        ANNOTATIONS_SQL,
        f"""SELECT doc_id, {_label} AS label, (seq // 4096)::INTEGER AS part,
  string_agg(page || '/' || type || '/' || text || '/' || color_name, '|' ORDER BY page, seq) AS items FROM ann GROUP BY ALL""",
    )

QUERIES["annotation_breakdown"] = lambda s, d: profiling.annotation_breakdown(annotations(s, d))
ORACLES["annotation_breakdown"] = with_ctes(
    ANNOTATIONS_SQL, "SELECT doc_id, type, count(*) AS count, count(DISTINCT dp) AS pages FROM (SELECT *, doc_id || '/' || page AS dp FROM ann) GROUP BY ROLLUP (doc_id, type)"
)


# ---- forms ----------------------------------------------------------------------------------------------------------


def form_fields(s, d) -> DataFrame:
    """Each customer's record as a filled form."""
    row = lambda name, kind, values, options=None: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), values.alias("values"), (F.array(*[F.lit(o) for o in options]) if options else F.lit(None).cast("array<string>")).alias("options")
    )
    rows = F.array(
        row("name", "text", F.array("c_name")),
        row("segment", "dropdown", F.array(F.col("c_mktsegment"), F.lit("any")), ["any", "none"]),
        row("vip", "checkbox", F.array(F.when(F.col("c_acctbal") > 5000, "true").otherwise("false"))),
        row("nation", "radio", F.array(F.col("c_nationkey").cast("string"))),
        row("memo", "signature", F.array(F.when(F.col("c_custkey") % 2 == 0, "N/A").otherwise("x"))),
        row("list", "listbox", F.array().cast("array<string>")),
    )
    return table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*")


FIELDS_SQL = """fields AS (
  SELECT c_custkey AS doc_id, 'name' AS name, 'text' AS type, c_name AS value, '' AS options FROM customer
  UNION ALL SELECT c_custkey, 'segment', 'dropdown', c_mktsegment || ', any', 'any|none' FROM customer
  UNION ALL SELECT c_custkey, 'vip', 'checkbox', CASE WHEN c_acctbal > 5000 THEN 'true' ELSE 'false' END, '' FROM customer
  UNION ALL SELECT c_custkey, 'nation', 'radio', c_nationkey::VARCHAR, '' FROM customer
  UNION ALL SELECT c_custkey, 'memo', 'text', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END, '' FROM customer
  UNION ALL SELECT c_custkey, 'list', 'listbox', '', '' FROM customer)"""


def _flat_options(df):
    return df.withColumn("options", F.coalesce(F.array_join("options", "|"), F.lit("")))


QUERIES["form_table"] = lambda s, d: _flat_options(profiling.form_table(form_fields(s, d)))
ORACLES["form_table"] = with_ctes(FIELDS_SQL, "SELECT * FROM fields")
QUERIES["form_counts"] = lambda s, d: profiling.form_counts(form_fields(s, d))
ORACLES["form_counts"] = with_ctes(
    FIELDS_SQL, "SELECT doc_id, count(*) AS count, count(*) FILTER (WHERE value <> '') AS filled FROM fields GROUP BY doc_id"
)
QUERIES["form_records"] = lambda s, d: profiling.form_records(form_fields(s, d), ["name", "segment", "vip", "memo"])
ORACLES["form_records"] = with_ctes(
    FIELDS_SQL,
    "SELECT doc_id, " + ", ".join(f"max(value) FILTER (WHERE name = '{n}') AS {n}" for n in ("name", "segment", "vip", "memo")) + " FROM fields GROUP BY doc_id",
)


def _fill(s, d):
    values = F.array(
        F.struct(F.lit("vip").alias("name"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("memo").alias("name"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("fax").alias("name"), F.lit("none").alias("value")),
    )
    firsts = table(s, d, "orders").groupBy("o_custkey").agg(
        F.min_by(F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("on"), "o_orderkey").alias("o_orderpriority"), F.min_by("o_orderstatus", "o_orderkey").alias("o_orderstatus")
    )
    return profiling.fill_form(form_fields(s, d), firsts.select(F.col("o_custkey").alias("doc_id"), F.explode(values).alias("v")).select("doc_id", "v.*"))


_FILL_SQL = FIELDS_SQL + """,
firsts AS (SELECT o_custkey AS doc_id, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY o_custkey)"""
QUERIES["fill_form"] = lambda s, d: _flat_options(_fill(s, d)[0])
ORACLES["fill_form"] = with_ctes(
    _FILL_SQL,
    """SELECT f.doc_id, f.name, f.type, CASE WHEN o.doc_id IS NULL THEN f.value WHEN f.name = 'vip' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
  WHEN f.name = 'memo' THEN o.st ELSE f.value END AS value, f.options FROM fields f LEFT JOIN firsts o USING (doc_id)""",
)
QUERIES["fill_form_unknown"] = lambda s, d: _fill(s, d)[1]
ORACLES["fill_form_unknown"] = "SELECT DISTINCT o_custkey AS doc_id, v.name FROM orders, (VALUES ('vip'), ('memo'), ('fax')) v(name) WHERE v.name = 'fax' OR o_custkey NOT IN (SELECT c_custkey FROM customer)"


# ---- profiles -------------------------------------------------------------------------------------------------------


BARE = 10**12


def _profile(s, d):
    docs = i.documents(s, d)
    # every document a second time, without pages, fields and objects
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + BARE))
    k = F.col("doc_id") % 4
    meta = docs.select(
        "doc_id",
        (F.length("text") * 5000).cast("bigint").alias("size"),
        F.lit("1.7").alias("version"),
        F.when(k == 0, "").when(k != 1, F.col("source")).alias("title"),
        F.col("lang").alias("author"),
        *[F.lit(None).cast("string").alias(c) for c in ("subject", "keywords", "creator", "producer")],
    )
    pages = i.doc_pages(s, d, 600).select(
        "doc_id", "page", F.lit(594.6).alias("width"), F.lit(841.4).alias("height"), F.when(F.col("doc_id") % 3 == 0, 90).otherwise(0).alias("rotation")
    )
    kinds = F.when(F.col("l_linenumber") % 3 == 0, "image").when(F.col("l_linenumber") == 7, "filespec").otherwise("font")
    objects = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), kinds.alias("kind"), F.concat(F.lit("F"), (F.col("l_partkey") % 30).cast("string")).alias("name"))
    fields = form_fields(s, d)
    notes = table(s, d, "events").select(F.col("user_id").alias("doc_id"))
    return profiling.doc_profile(meta, pages, fields, objects, notes)


PROFILE_SQL = i.doc_pages_sql("p", 600) + f""",
twice AS (SELECT doc_id, text, source, lang, lang = 'es' AS bad FROM documents UNION ALL SELECT doc_id + {BARE}, text, source, lang, false FROM documents),
objs AS (SELECT l_suppkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN 'image' WHEN l_linenumber = 7 THEN 'filespec' ELSE 'font' END AS kind, 'F' || (l_partkey % 30) AS name FROM lineitem),
fonts AS (SELECT doc_id, list_sort(list(DISTINCT name)) AS names FROM objs WHERE kind = 'font' GROUP BY doc_id),
others AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'filespec') AS specs FROM objs GROUP BY doc_id),
pg AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
ev AS (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY user_id),
profile AS (
  SELECT d.doc_id, coalesce(pg.n, 0) AS page_count, (length(d.text) * 5000)::BIGINT AS file_size, '1.7' AS pdf_version,
    CASE WHEN pg.n > 0 THEN 595 END AS page_width, CASE WHEN pg.n > 0 THEN 841 END AS page_height,
    CASE WHEN pg.n > 0 AND d.doc_id % 3 = 0 THEN 90 END AS page_rotation, CASE WHEN d.doc_id % 4 > 1 THEN d.source END AS title, d.lang AS author,
    NULL::VARCHAR AS subject, NULL::VARCHAR AS keywords, NULL::VARCHAR AS creator, NULL::VARCHAR AS producer,
    c.c_custkey IS NOT NULL AS has_form, CASE WHEN c.c_custkey IS NOT NULL THEN 6::BIGINT END AS form_field_count,
    coalesce(o.specs, 0) > 0 AS has_embedded_files, nullif(o.images, 0) AS image_count, len(f.names)::BIGINT AS font_count,
    array_to_string(f.names, '|') AS font_names, ev.n AS annotation_count
  FROM twice d LEFT JOIN pg USING (doc_id) LEFT JOIN others o USING (doc_id) LEFT JOIN fonts f USING (doc_id) LEFT JOIN ev USING (doc_id)
  LEFT JOIN customer c ON c.c_custkey = d.doc_id)"""

QUERIES["doc_profile"] = lambda s, d: _profile(s, d).withColumn("font_names", F.array_join("font_names", "|"))
ORACLES["doc_profile"] = with_ctes(PROFILE_SQL, "SELECT * FROM profile")


def _issues(s, d):
    errors = i.documents(s, d).filter("lang = 'es'").select("doc_id", F.concat(F.lit("bad "), "source").alias("message"))
    return profiling.doc_issues(_profile(s, d), errors)


ISSUES_SQL = PROFILE_SQL + """,
issues AS (
  SELECT p.doc_id, NOT d.bad AS valid, list_filter([
    CASE WHEN NOT d.bad AND page_count = 0 THEN 'Document has no pages' END, CASE WHEN NOT d.bad AND title IS NULL THEN 'Missing title metadata' END,
    CASE WHEN NOT d.bad AND file_size > 52428800 THEN 'File size exceeds 50MB - may cause performance issues' END,
    CASE WHEN d.bad THEN 'Parse error: bad ' || d.source END], lambda x: x IS NOT NULL) AS xs
  FROM profile p JOIN twice d USING (doc_id))"""
QUERIES["doc_issues"] = lambda s, d: _issues(s, d).withColumn("issues", F.array_join("issues", "|"))
ORACLES["doc_issues"] = with_ctes(ISSUES_SQL, "SELECT doc_id, valid, array_to_string(xs, '|') AS issues FROM issues")
QUERIES["issue_counts"] = lambda s, d: profiling.issue_counts(_issues(s, d))
ORACLES["issue_counts"] = with_ctes(ISSUES_SQL, "SELECT issue, count(*) AS documents FROM (SELECT unnest(xs) AS issue FROM issues) GROUP BY issue")


# ---- citations ------------------------------------------------------------------------------------------------------


def cited_docs(s, d) -> DataFrame:
    """Documents with in-text citations and a list of references, under a heading or without."""
    n = F.col("doc_id")
    year, later = (F.lit(1890) + n % 130).cast("string"), (F.lit(1950) + n % 70).cast("string")
    word = F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z ]", "")
    name = F.concat(F.initcap("lang"), F.lit("son"))
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    body = c(F.replace("text", F.lit(".\n"), F.lit(". As shown (Enson et al., 1999) and (Miller & Roe, 2004, p. 7).\n")), "\nsee (", name, ", ", year, ").")
    e1 = c(name, ", J. A., Miller, B. (", year, "). ", word, " title. Journal of ", F.col("source"), ", vol. 3, no. 2, pp. 10-20. 10.1234/abc.", (n % 50).cast("string"))
    e2 = c(name, ", K. (", later, "). The ", word, " book. MIT Press.")
    e3 = c("Who, X. \"Quoted ", word, " title\" ", later, ". https://ex.org/", n.cast("string"), ", accessed")
    e4 = c("Doe, A., Roe, B., Poe, C., Moe, D. Nature letters 12(3), 45-67. ", year, ".")
    numbered = c("[1] ", e1, "\n[2] ", e2, "\n[3] ", e3, "\n(4) ", e4, "\n[5] Short one.")
    plain = c("\n", e1, "\n\n", e2, "\n", e3, "\n", e4, "\nno year in this closing entry at all.")
    text = (
        F.when(n % 6 == 3, c(body, "    References     ", numbered))
        .when(n % 3 == 0, c(body, "\n  REFERENCES \n", numbered))
        .when(n % 3 == 1, c(body, "\n", numbered))
        .otherwise(c(body, F.when(n % 2 == 0, "\nWorks  cited\n").otherwise("\n"), plain))
    )
    return i.documents(s, d).select("doc_id", text.alias("text"))


_E1 = "nm || ', J. A., Miller, B. (' || y || '). ' || w || ' title. Journal of ' || source || ', vol. 3, no. 2, pp. 10-20. 10.1234/abc.' || (doc_id % 50)"
_E2 = "nm || ', K. (' || l || '). The ' || w || ' book. MIT Press.'"
_E3 = "'Who, X. \"Quoted ' || w || ' title\" ' || l || '. https://ex.org/' || doc_id || ', accessed'"
_E4 = "'Doe, A., Roe, B., Poe, C., Moe, D. Nature letters 12(3), 45-67. ' || y || '.'"
_NL = "chr(10)"
CITED_SQL = f"""cited AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 1 THEN body || '    References     ' || numbered ELSE body || {_NL} || '  REFERENCES ' || {_NL} || numbered END WHEN 1 THEN body || {_NL} || numbered
    ELSE body || CASE WHEN doc_id % 2 = 0 THEN {_NL} || 'Works  cited' || {_NL} ELSE {_NL} END || plain END AS text
  FROM (SELECT doc_id,
    replace(text, '.' || {_NL}, '. As shown (Enson et al., 1999) and (Miller & Roe, 2004, p. 7).' || {_NL}) || {_NL} || 'see (' || nm || ', ' || y || ').' AS body,
    '[1] ' || {_E1} || {_NL} || '[2] ' || {_E2} || {_NL} || '[3] ' || {_E3} || {_NL} || '(4) ' || {_E4} || {_NL} || '[5] Short one.' AS numbered,
    {_NL} || {_E1} || {_NL} || {_NL} || {_E2} || {_NL} || {_E3} || {_NL} || {_E4} || {_NL} || 'no year in this closing entry at all.' AS plain
    FROM (SELECT doc_id, text, source, (1890 + doc_id % 130)::VARCHAR AS y, (1950 + doc_id % 70)::VARCHAR AS l,
      regexp_replace(substring(text, 1, 40), '[^A-Za-z ]', '', 'g') AS w, upper(lang[1]) || lang[2:] || 'son' AS nm FROM documents)))"""

SECTION_SQL = f"""{CITED_SQL},
cited_lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS line_no FROM (SELECT doc_id, string_split_regex(text, '\\n|\\s{{3,}}') AS ls FROM cited)),
starts AS (
  SELECT doc_id, coalesce(min(line_no) FILTER (WHERE regexp_matches({trim_sql('line')},
      '(?i)^(references?|bibliography|works?\\s+cited|sources?|literature\\s+cited|citations?|notes?\\s+and\\s+references?)\\s*$')) + 1,
    min(line_no) FILTER (WHERE regexp_matches(line, '^\\s*[\\[\\(]?1[\\]\\)]?\\.?\\s+[A-Z]'))) AS start FROM cited_lines GROUP BY doc_id),
section AS (SELECT l.* FROM cited_lines l JOIN starts s USING (doc_id) WHERE l.line_no >= coalesce(s.start, 1))"""


def cited_lines(s, d) -> DataFrame:
    return cited_docs(s, d).select("doc_id", F.posexplode(F.split("text", citations.LINE_CUT)).alias("k", "line")).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


QUERIES["reference_section"] = lambda s, d: citations.reference_section(cited_lines(s, d))
ORACLES["reference_section"] = with_ctes(SECTION_SQL, "SELECT doc_id, line_no, line FROM section")

_YEAR = "\\b(1[89]\\d{2}|20[0-2]\\d)\\b"
ENTRIES_SQL = f"""{SECTION_SQL},
cut AS (SELECT doc_id, string_agg(line, {_NL} ORDER BY line_no) AS text FROM section GROUP BY doc_id),
sect AS (SELECT doc_id, CASE WHEN start IS NULL THEN d.text ELSE c.text END AS text FROM cut c JOIN starts USING (doc_id) JOIN cited d USING (doc_id)),
cuts AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)(?:^|\\n)\\s*[\\[\\(]?\\d+[\\]\\)]?\\.?\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda e: {trim_sql('e')}), lambda e: length(e) > 20) AS numbered,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n{{2,}}', chr(1), 'g'), '\\n([A-Z][a-z]+,?\\s+[A-Z])', chr(1) || '\\1', 'g'), chr(1)),
      lambda e: {trim_sql(f"replace(e, {_NL}, ' ')")}), lambda e: length(e) > 20 AND regexp_matches(e, {q(_YEAR)})) AS plain FROM sect),
entries AS (
  SELECT doc_id, unnest(xs) AS raw, generate_subscripts(xs, 1)::INTEGER AS entry_no FROM (
    SELECT doc_id, CASE WHEN len(numbered) > 1 THEN numbered ELSE plain END AS xs FROM cuts))"""


def _entries(s, d):
    return citations.split_entries(citations.reference_texts(cited_docs(s, d)))


QUERIES["split_entries"] = _entries
ORACLES["split_entries"] = with_ctes(ENTRIES_SQL, "SELECT doc_id, entry_no, raw FROM entries")

_AUTH = "([A-Z][a-zA-Z''\\-]+),\\s+([A-Z][a-zA-Z]*\\.?(?:\\s+[A-Z]\\.?)*)"
PARSED_SQL = f"""{ENTRIES_SQL},
base AS (
  SELECT *, regexp_extract(raw, {q(_YEAR)}, 1) AS year, regexp_extract(raw, '\\b(10\\.\\d{{4,}}/[^\\s,;]+)', 1) AS doi,
    regexp_extract_all(raw, '{_AUTH}', 1) AS lasts, regexp_extract_all(raw, '{_AUTH}', 2) AS firsts,
    CASE WHEN regexp_matches(raw, '(?i)pp?\\.\\s*([\\d–\\-]+)') THEN regexp_extract(raw, '(?i)pp?\\.\\s*([\\d–\\-]+)', 1)
      ELSE regexp_extract(raw, '(\\d+)\\s*[\\(\\[]\\s*(\\d+)\\s*[\\)\\]]\\s*,?\\s*(?:pp?\\.\\s*)?([\\d–\\-]+)', 3) END AS pages,
    regexp_extract(raw, '(?i)vol(?:ume)?\\.?\\s*(\\d+)', 1) AS volume, regexp_extract(raw, '(?i)(?:no|issue|iss)\\.?\\s*(\\d+)', 1) AS issue,
    {trim_sql("regexp_replace(raw, '.*?[0-9]{4}[).]" + chr(92) + "s*', '')")} AS after_year FROM entries),
titled AS (
  SELECT *, CASE WHEN doi = '' THEN regexp_extract(raw, 'https?://[^\\s,;>)]+') ELSE '' END AS url,
    CASE WHEN regexp_matches(raw, '["“](.+?)["”]') THEN regexp_extract(raw, '["“](.+?)["”]', 1)
      WHEN strpos(after_year, '. ') > 1 THEN substring(after_year, 1, strpos(after_year, '. ') - 1) ELSE after_year END AS title,
    CASE WHEN volume <> '' OR pages <> '' THEN 'journal' WHEN regexp_matches(raw, '(?i)(press|publish|edition|ed\\.)') THEN 'book'
      WHEN regexp_matches(raw, 'https?://') THEN 'website' ELSE 'unknown' END AS type FROM base),
parsed AS (
  SELECT *, CASE WHEN type = 'journal' THEN {trim_sql("regexp_extract(" + trim_sql("CASE WHEN title <> '' AND strpos(raw, title) > 0 THEN substring(raw, 1, strpos(raw, title) - 1) || substring(raw, strpos(raw, title) + length(title)) ELSE raw END") + ", '" + chr(92) + ".\\s+([A-Z][^.]+?)\\s*,?\\s*(?:vol|Vol|\\d+[\\(\\[])', 1)")} ELSE '' END AS journal,
    CASE WHEN type = 'book' THEN {trim_sql("regexp_extract(raw, '([A-Z][^.]+?(?:Press|Publishers?|Publishing))', 1)")} ELSE '' END AS publisher FROM titled)"""


def _parsed(s, d):
    return citations.parse_entries(_entries(s, d))


QUERIES["parse_entries"] = lambda s, d: _parsed(s, d).withColumn(
    "authors", F.array_join(F.transform("authors", lambda a: F.concat_ws(", ", a["last"], a["first"])), "; ")
)
ORACLES["parse_entries"] = with_ctes(
    PARSED_SQL,
    """SELECT doc_id, entry_no, raw, array_to_string(list_transform(lasts, lambda x, k: x || ', ' || firsts[k]), '; ') AS authors, year, title, journal,
  publisher, volume, issue, pages, doi, url, type FROM parsed""",
)
QUERIES["distinct_works"] = lambda s, d: citations.distinct_works(_parsed(s, d))
ORACLES["distinct_works"] = with_ctes(
    PARSED_SQL,
    """SELECT CASE WHEN doi <> '' THEN lower(doi) ELSE lower(title) || '|' || year END AS work, min(type) AS type, min(year) AS year,
  count(*) AS citations, count(DISTINCT doc_id) AS documents FROM parsed GROUP BY work""",
)

IN_TEXT_SQL = f"""in_text AS (
  SELECT doc_id, c AS citation, row_number() OVER (PARTITION BY doc_id ORDER BY min(k))::INTEGER AS pos,
    regexp_extract(c, '^\\(([A-Z][a-z]+)', 1) AS last, regexp_extract(c, '(1[89]\\d{{2}}|20[0-2]\\d)', 1) AS year
  FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text,
    '\\(([A-Z][a-z]+(?:\\s+et\\s+al\\.?)?(?:,?\\s+&\\s+[A-Z][a-z]+)*),?\\s+(1[89]\\d{{2}}|20[0-2]\\d)(?:,\\s*p+\\.?\\s*[\\d–\\-]+)?\\)') AS cs FROM cited))
  GROUP BY doc_id, c)"""
QUERIES["in_text_citations"] = lambda s, d: citations.in_text_citations(cited_docs(s, d))
ORACLES["in_text_citations"] = with_ctes([CITED_SQL, IN_TEXT_SQL], "SELECT doc_id, pos, citation, last, year FROM in_text")
QUERIES["citation_counts"] = lambda s, d: citations.citation_counts(citations.in_text_citations(cited_docs(s, d)))
ORACLES["citation_counts"] = with_ctes([CITED_SQL, IN_TEXT_SQL], "SELECT citation, count(*) AS documents FROM in_text GROUP BY citation")
QUERIES["in_text_coverage"] = lambda s, d: citations.in_text_coverage(citations.in_text_citations(cited_docs(s, d)), _parsed(s, d))
ORACLES["in_text_coverage"] = with_ctes(
    [PARSED_SQL, IN_TEXT_SQL],
    """SELECT t.doc_id, t.last, t.year, t.pos, t.citation,
  EXISTS (FROM parsed p WHERE p.doc_id = t.doc_id AND p.year = t.year AND list_contains(p.lasts, t.last)) AS listed FROM in_text t""",
)


def _bib_sql(style: str) -> str:
    head = "lasts[1] || ', ' || firsts[1]"
    who = {
        "apa": "array_to_string(list_transform(lasts, lambda x, k: x || ', ' || array_to_string(list_transform(regexp_split_to_array(firsts[k], '\\s+'), lambda n: n[1] || '.'), ' ')), ', ')",
        "mla": f"CASE len(lasts) WHEN 1 THEN {head} WHEN 2 THEN {head} || ', and ' || firsts[2] || ' ' || lasts[2] ELSE {head} || ', et al.' END",
        "chicago": f"CASE WHEN len(lasts) = 1 THEN {head} WHEN len(lasts) > 3 THEN {head} || ' et al.' ELSE {head} || ', ' || array_to_string(list_transform(lasts[2:], lambda x, k: firsts[k + 1] || ' ' || x), ', ') END",
    }[style]
    a = f"CASE WHEN len(lasts) = 0 THEN 'Unknown Author' ELSE {who} END"
    link = "CASE WHEN doi <> '' THEN ' https://doi.org/' || doi WHEN url <> '' THEN ' ' || url ELSE '' END"
    t = "CASE title WHEN '' THEN 'Untitled' ELSE title END"
    rt = "CASE title WHEN '' THEN substring(raw, 1, 100) ELSE title END"
    j, p = "CASE journal WHEN '' THEN 'Journal' ELSE journal END", "CASE publisher WHEN '' THEN 'Publisher' ELSE publisher END"
    y = "CASE year WHEN '' THEN 'n.d.' ELSE year END"
    no = "CASE issue WHEN '' THEN '' ELSE ', no. ' || issue END"
    if style == "apa":
        lead = f"{a} || CASE year WHEN '' THEN '.' ELSE ' (' || year || ').' END"
        vol = "CASE volume WHEN '' THEN '' ELSE ', ' || volume || CASE issue WHEN '' THEN '' ELSE '(' || issue || ')' END END"
        cases = (
            f"{lead} || ' ' || CASE title WHEN '' THEN '' ELSE title || '.' END || ' *' || {j} || '*' || {vol} || CASE pages WHEN '' THEN '' ELSE ', ' || pages END || '.' || {link}",
            f"{lead} || ' *' || {t} || '*. ' || {p} || '.' || {link}", f"{lead} || ' ' || {t} || '. Retrieved from ' || url", f"{lead} || ' ' || {rt} || '.' || {link}",
        )
    elif style == "mla":
        vol = f"CASE volume WHEN '' THEN '' ELSE ', vol. ' || volume || {no} END"
        cases = (
            f"{a} || '. \"' || {t} || '.\" *' || {j} || '*' || {vol} || ', ' || {y} || CASE pages WHEN '' THEN '' ELSE ', pp. ' || pages END || '.' || {link}",
            f"{a} || '. *' || {t} || '*. ' || {p} || ', ' || {y} || '.'", f"{a} || '. \"' || {t} || '.\" *Website*, ' || {y} || ', ' || url || '.'", f"{a} || '. \"' || {rt} || '.\" ' || {y} || '.'",
        )
    else:
        vol = f"CASE volume WHEN '' THEN '' ELSE ' ' || volume || {no} END"
        lead = f"{a} || '. ' || {y} || '. '"
        cases = (
            f"{lead} || '\"' || {t} || '.\" *' || {j} || '*' || {vol} || CASE pages WHEN '' THEN '' ELSE ': ' || pages END || '.' || {link}",
            f"{lead} || '*' || {t} || '*. ' || {p} || '.'", f"{lead} || '\"' || {t} || '.\" ' || url || '.'", f"{lead} || '\"' || {rt} || '.\"'",
        )
    return with_ctes(
        PARSED_SQL,
        f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY entry_no))::INTEGER AS n,
  CASE type WHEN 'journal' THEN {cases[0]} WHEN 'book' THEN {cases[1]} WHEN 'website' THEN {cases[2]} ELSE {cases[3]} END AS formatted FROM parsed""",
    )


for _style in citations.STYLES:
    QUERIES[f"bibliography_{_style}_limited"] = lambda s, d, st=_style: citations.bibliography(_parsed(s, d), st, citations.RAW_TITLE_CHARS)
    ORACLES[f"bibliography_{_style}_limited"] = _bib_sql(_style)
    QUERIES[f"bibliography_{_style}"] = lambda s, d, st=_style: citations.bibliography(_parsed(s, d), st)
    ORACLES[f"bibliography_{_style}"] = _bib_sql(_style).replace("substring(raw, 1, 100)", "raw")
