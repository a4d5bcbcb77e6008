"""Registered queries: parsed responses, tasks, highlights, snippets, questions, OCR results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import WS, trim_ws
from leafmill.operators import grounding, responses, structure
from leafmill.plans import inputs as i
from leafmill.plans.inputs import q, trim_sql, with_ctes
from leafmill.plans.structure_queries import HEADED_PAGES_SQL, headed_pages, paragraphs_sql

QUERIES = {}
ORACLES = {}


def pick(values: list, by):
    """Element of a short list chosen by a row's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def pick_sql(values: list, by: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else q(v)}" for k, v in enumerate(values))
    return f"CASE ({by}) % {len(values)} {cases} END"


# ---- responses ------------------------------------------------------------------------------------------------------

WORDS_SQL = "regexp_replace(substring(text, 1, 40), '[^A-Za-z ]', '', 'g')"


def answers(s, d) -> DataFrame:
    """One model response per document, in the five shapes responses come in."""
    w = F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z ]", "")
    k = F.col("doc_id") % 5
    content = (
        F.when(k == 0, F.concat(F.lit('Sure:\n```json\n{"answer":"'), w, F.lit('","citations":[{"page":2,"quote":"'), w, F.lit('"},{"page":9}],"found":false}\n```')))
        .when(k == 1, F.concat(F.lit('{"answer":"'), w, F.lit('"}')))
        .when(k == 2, F.concat(F.col("text"), F.lit(" (Page 3) and (chapter  12), again (page 3)")))
        .when(k == 3, F.concat(F.lit("I Couldn't find information about that. "), F.col("text")))
        .otherwise(F.concat(F.lit('```\n{"citations":[{"page":1,"quote":"'), w, F.lit('"}]}\n```')))
    )
    return i.documents(s, d).select(F.col("doc_id").alias("resp_id"), "doc_id", content.alias("content"))


ANSWERS_SQL = f"""answers AS (
  SELECT doc_id AS resp_id, doc_id, doc_id % 5 AS k, {WORDS_SQL} AS w, CASE doc_id % 5
    WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"answer":"' || {WORDS_SQL} || '","citations":[{{"page":2,"quote":"' || {WORDS_SQL} || '"}},{{"page":9}}],"found":false}}' || chr(10) || '```'
    WHEN 1 THEN '{{"answer":"' || {WORDS_SQL} || '"}}'
    WHEN 2 THEN text || ' (Page 3) and (chapter  12), again (page 3)'
    WHEN 3 THEN 'I Couldn''t find information about that. ' || text
    ELSE '```' || chr(10) || '{{"citations":[{{"page":1,"quote":"' || {WORDS_SQL} || '"}}]}}' || chr(10) || '```' END AS content FROM documents)"""


def _flat_answers(df):
    cites = F.transform("citations", lambda c: F.concat_ws(":", c["page"].cast("string"), F.coalesce(c["quote"], F.lit("-"))))
    return df.select("resp_id", "answer", F.array_join(cites, "|").alias("citations"), "found")


QUERIES["parse_responses_qa"] = lambda s, d: _flat_answers(responses.parse_responses(answers(s, d), "qa"))
ORACLES["parse_responses_qa"] = with_ctes(
    ANSWERS_SQL,
    """SELECT resp_id, CASE WHEN k < 2 AND w <> '' THEN w ELSE content END AS answer,
  CASE k WHEN 0 THEN '2:' || w || '|9:-' WHEN 4 THEN '1:' || w ELSE '' END AS citations, k <> 0 AS found FROM answers""",
)
QUERIES["parse_responses_chat"] = lambda s, d: _flat_answers(responses.parse_responses(answers(s, d), "chat"))
ORACLES["parse_responses_chat"] = with_ctes(
    ANSWERS_SQL,
    """SELECT resp_id, CASE WHEN k < 2 AND w <> '' THEN w ELSE content END AS answer,
  CASE WHEN k = 0 AND w <> '' THEN '2:' || w || '|9:-' WHEN k = 2 THEN '3:|12:' ELSE '' END AS citations,
  CASE WHEN k = 0 AND w <> '' THEN false ELSE k <> 3 END AS found FROM answers""",
)

QUERIES["citation_coverage"] = lambda s, d: responses.citation_coverage(
    responses.parse_responses(answers(s, d), "chat"), i.doc_pages(s, d)
)
ORACLES["citation_coverage"] = with_ctes(
    [ANSWERS_SQL, i.doc_pages_sql()],
    """, cited AS (SELECT doc_id, unnest(CASE WHEN k = 0 AND w <> '' THEN [2, 9] WHEN k = 2 THEN [3, 12] ELSE [] END)::INTEGER AS page FROM answers)
SELECT c.doc_id, c.page, count(*) AS citations, bool_or(p.doc_id IS NOT NULL) AS page_exists
FROM cited c LEFT JOIN doc_pages p USING (doc_id, page) GROUP BY c.doc_id, c.page""",
)


# ---- tasks ----------------------------------------------------------------------------------------------------------


def task_responses(s, d) -> DataFrame:
    """English documents answer in JSON, German ones in broken JSON, all others as a bulleted text."""
    w = F.regexp_replace(F.substring("text", 1, 30), "[^A-Za-z ]", "")
    t1 = F.concat(F.lit('{"id":"T9","title":"'), w, F.lit('","owner":"","deadline":"Unspecified","priority":"urgent"}'))
    t2 = F.concat(F.lit('{"action":"'), w, F.lit(' x","owner":"Ann","deadline":"'), F.col("source"), F.lit('","priority":"asap","category":"legal"}'))
    lines = F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit("\n12) • short\n2) -  \n  3. indented line"))
    content = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Here:\n```json\nnote {\"tasks\":["), t1, F.lit(","), t2, F.lit(",{}]} end\n```")))
        .when(F.col("lang") == "de", F.concat(F.lit("{\"tasks\": [ {\"action\": \"open\"\n"), F.col("text")))
        .otherwise(lines)
    )
    return i.documents(s, d).select(F.col("doc_id").alias("resp_id"), "doc_id", content.alias("content"))


TASKS_SQL = f"""tw AS (SELECT doc_id, lang, source, text, regexp_replace(substring(text, 1, 30), '[^A-Za-z ]', '', 'g') AS w FROM documents),
task_text AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS n FROM (
    SELECT doc_id, list_filter(string_split(CASE lang WHEN 'de' THEN '{{"tasks": [ {{"action": "open"' || chr(10) || text
      ELSE '1. ' || replace(text, chr(10), chr(10) || '- ') || chr(10) || '12) • short' || chr(10) || '2) -  ' || chr(10) || '  3. indented line' END, chr(10)),
      lambda x: length({trim_sql('x')}) > 10) AS ls FROM tw WHERE lang <> 'en')),
tasks AS (
  SELECT doc_id AS resp_id, doc_id, 1 AS task_no, 'T9' AS id, CASE WHEN w = '' THEN 'Untitled task' ELSE w END AS action, 'Unassigned' AS owner,
    '' AS deadline, 'urgent' AS priority, '' AS context, 'other' AS category FROM tw WHERE lang = 'en'
  UNION ALL SELECT doc_id, doc_id, 2, 'task-2', w || ' x', 'Ann', source, 'medium', '', 'legal' FROM tw WHERE lang = 'en'
  UNION ALL SELECT doc_id, doc_id, 3, 'task-3', 'Untitled task', 'Unassigned', '', 'medium', '', 'other' FROM tw WHERE lang = 'en'
  UNION ALL SELECT * FROM (SELECT doc_id, doc_id, n, 'task-' || n,
    {trim_sql("regexp_replace(regexp_replace(line, '^[0-9]+[.)]" + chr(92) + "s*', ''), '^[-*•]" + chr(92) + "s*', '')")} AS action, 'Unassigned', '', 'medium', '', 'other' FROM task_text)
  WHERE action <> '')"""

QUERIES["normalise_tasks"] = lambda s, d: responses.normalise_tasks(task_responses(s, d))
ORACLES["normalise_tasks"] = with_ctes(TASKS_SQL, "SELECT * FROM tasks")


def _merged_tasks(s, d):
    """A source's documents are the parts of one long document; each answer comes twice."""
    tasks = responses.normalise_tasks(task_responses(s, d)).join(i.documents(s, d).select("doc_id", "source"), "doc_id")
    twice = tasks.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return responses.merge_tasks(
        twice.select(
            F.col("source").alias("doc_id"), (F.col("doc_id") * 2 + F.col("copy")).alias("part"), "task_no", "id",
            F.when(F.col("copy") == 1, F.replace("action", F.lit("e"), F.lit("E"))).otherwise(F.col("action")).alias("action"), "owner", "deadline", "priority", "context", "category",
        )
    )


QUERIES["merge_tasks"] = _merged_tasks
ORACLES["merge_tasks"] = with_ctes(
    TASKS_SQL,
    """, twice AS (
  SELECT d.source AS doc_id, t.doc_id * 2 + c AS part, t.task_no, CASE c WHEN 1 THEN replace(action, 'e', 'E') ELSE action END AS action, owner, deadline, priority, context, category
  FROM tasks t JOIN documents d USING (doc_id), (VALUES (0), (1)) v(c)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(action), lower(owner) ORDER BY part, task_no) AS r FROM twice)
SELECT doc_id, part, task_no, 'task-' || row_number() OVER (PARTITION BY doc_id ORDER BY part, task_no) AS id, action, owner, deadline, priority, context, category
FROM ranked WHERE r = 1""",
)


def _first_task_rows(s, d):
    """Passages of every document; a third of them got no usable answer."""
    silent = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("content"))
    texts = i.documents(s, d).select(F.col("doc_id").alias("resp_id"), "text")
    return responses.first_task(task_responses(s, d).withColumn("content", silent), texts)


QUERIES["first_task"] = _first_task_rows
ORACLES["first_task"] = with_ctes(
    TASKS_SQL,
    """, firsts AS (SELECT resp_id, min(task_no) AS task_no FROM tasks WHERE resp_id % 3 <> 0 GROUP BY resp_id)
SELECT d.doc_id AS resp_id, t.id, coalesce(t.action, d.text) AS action, t.owner, t.deadline,
  coalesce(t.priority, 'medium') AS priority, t.context, coalesce(t.category, 'follow-up') AS category
FROM documents d LEFT JOIN firsts f ON f.resp_id = d.doc_id LEFT JOIN tasks t ON t.resp_id = f.resp_id AND t.task_no = f.task_no""",
)


def _analyses(s, d):
    """Parts of a source's analysis: words of each document as list items."""
    ws = F.filter(F.split("text", WS + "+"), lambda w: F.length(w) > 0)
    parts = i.documents(s, d).select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("part"), (F.length("text") % 100).cast("double").alias("sentiment_score"),
        F.slice(ws, 1, 2).alias("insights"), F.slice(ws, 2, 2).alias("strengths"), F.slice(ws, 3, 2).alias("weaknesses"),
        F.slice(ws, 4, 1).alias("recommendations"), F.array("lang").alias("topics"),
    )
    out = responses.merge_analyses(parts)
    return out.select("doc_id", "parts", F.round("sentiment_score", 6).alias("sentiment_score"), *[F.array_join(c, "|").alias(c) for c in responses.LIST_CAPS])


QUERIES["merge_analyses"] = _analyses
ORACLES["merge_analyses"] = with_ctes(
    f"""src AS (SELECT source, doc_id, lang, text, list_filter(regexp_split_to_array(text, {q(WS + '+')}), lambda w: length(w) > 0) AS ws FROM documents),
items AS (
  SELECT source, field, cap, item, min(doc_id * 100 + k) AS seen FROM (
    SELECT source, doc_id, field, cap, unnest(xs) AS item, generate_subscripts(xs, 1) AS k FROM (
      SELECT source, doc_id, 'insights' AS field, 8 AS cap, ws[1:2] AS xs FROM src UNION ALL SELECT source, doc_id, 'strengths', 6, ws[2:3] FROM src
      UNION ALL SELECT source, doc_id, 'weaknesses', 6, ws[3:4] FROM src UNION ALL SELECT source, doc_id, 'recommendations', 6, ws[4:4] FROM src
      UNION ALL SELECT source, doc_id, 'topics', 6, [lang] FROM src)) GROUP BY source, field, cap, item),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY seen) AS r FROM items)),
scores AS (SELECT source, count(*) AS parts, round(avg((length(text) % 100)::DOUBLE), 6) AS sentiment_score FROM src GROUP BY source)""",
    "SELECT s.source AS doc_id, any_value(s.parts) AS parts, any_value(s.sentiment_score) AS sentiment_score, "
    + ", ".join(f"coalesce(string_agg(item, '|' ORDER BY r) FILTER (WHERE field = '{f}'), '') AS {f}" for f in responses.LIST_CAPS)
    + " FROM scores s LEFT JOIN top t USING (source) GROUP BY s.source",
)


# ---- highlights -----------------------------------------------------------------------------------------------------

IMPORTANCE = ["critical", "high", "medium", "low"]
CATEGORY = ["risk", "", "amount", "finding", None]
CONFIDENCE = ["abc", "-4", "140", "62.5", None, "", "88", "1e1"]
DOC_TYPES = ["invoice", "report", "manual", "unheard_of", None]


def highlights(s, d) -> DataFrame:
    """Every line of a document as a highlight, and a second one that adds a word at its end."""
    lines = i.documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    lines = lines.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.col("doc_id") + F.col("k") + F.col("v") * 3
    return lines.select(
        "doc_id",
        (F.col("k") * 2 + F.col("v")).alias("hl_id"),
        F.when(F.col("v") == 1, F.concat(F.lit(" "), "line", F.lit(" indeed"))).otherwise(F.col("line")).alias("text"),
        pick(IMPORTANCE, n).alias("importance"),
        pick(CATEGORY, n).alias("category"),
        F.concat(F.lit(" r"), F.col("k").cast("string")).alias("reason"),
        pick(CONFIDENCE, n).alias("confidence"),
    )


HIGHLIGHTS_SQL = f"""highlights AS (
  SELECT doc_id, ((k - 1) * 2 + v)::INTEGER AS hl_id, CASE v WHEN 1 THEN ' ' || line || ' indeed' ELSE line END AS text,
    {pick_sql(IMPORTANCE, 'doc_id + k - 1 + v * 3')} AS importance, {pick_sql(CATEGORY, 'doc_id + k - 1 + v * 3')} AS category,
    ' r' || (k - 1) AS reason, {pick_sql(CONFIDENCE, 'doc_id + k - 1 + v * 3')} AS confidence
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), (VALUES (0), (1)) c(v)),
norm_hl AS (
  SELECT doc_id, hl_id, {trim_sql('text')} AS text, CASE WHEN importance = 'low' THEN 'medium' ELSE importance END AS importance,
    CASE WHEN coalesce(category, '') = '' THEN 'key_finding' ELSE category END AS category, {trim_sql('reason')} AS reason,
    CASE WHEN coalesce(confidence, '') = '' THEN 0 WHEN confidence = 'abc' THEN 75 WHEN confidence = '-4' THEN 0 WHEN confidence = '140' THEN 100
      WHEN confidence = '62.5' THEN 63 WHEN confidence = '1e1' THEN 10 ELSE 88 END AS confidence FROM highlights)"""


def _normalised(s, d):
    types = i.documents(s, d).select("doc_id", pick(DOC_TYPES, F.col("doc_id")).alias("document_type"))
    return grounding.normalise_highlights(highlights(s, d), types)


QUERIES["normalise_highlights"] = _normalised
ORACLES["normalise_highlights"] = with_ctes(
    HIGHLIGHTS_SQL,
    f"""SELECT n.*, {pick_sql(DOC_TYPES, 'n.doc_id')} AS document_type, CASE n.doc_id % 5
    WHEN 0 THEN category NOT IN ('amount', 'due_date', 'vendor', 'line_item', 'tax', 'payment_terms', 'financial')
    WHEN 1 THEN category NOT IN ('key_finding', 'conclusion', 'recommendation', 'risk', 'financial', 'important_date')
    WHEN 2 THEN category NOT IN ('instruction', 'warning', 'definition', 'risk')
    ELSE category NOT IN ('key_finding', 'action_required', 'important_date', 'financial', 'risk', 'definition', 'conclusion') END AS off_profile
FROM norm_hl n""",
)


def norm_sql(expr: str) -> str:
    bare = f"strip_accents(replace(replace({expr}, '…', '...'), 'ß', 'ß'))"
    kept = f"regexp_replace({bare}, {q('[^' + chr(92) + 'w' + WS[1:-1] + '.,;:!?()/-]')}, ' ', 'g')"
    return f"lower({i.squeeze_sql(kept)})"


def shingles_sql(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - 2), lambda k: array_to_string({words}[k:k + 3], ' ')))"


def _merged(s, d, max_n=None):
    out = grounding.merge_highlights(_normalised(s, d), max_n)
    return out.select("doc_id", "hl_id", "text", "importance", "confidence", "position")


QUERIES["merge_highlights_limited"] = lambda s, d: _merged(s, d, 10)
ORACLES["merge_highlights_limited"] = with_ctes(
    HIGHLIGHTS_SQL,
    f""", ranked AS (
  SELECT *, {norm_sql('text')} AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY CASE importance WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, confidence DESC, hl_id) AS rk FROM norm_hl),
firsts AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY rk) = 1),
bags AS (SELECT *, CASE WHEN len(ws) >= 4 THEN {shingles_sql('ws')} ELSE [] END AS gs FROM (SELECT *, list_filter(string_split(norm, ' '), lambda w: w <> '') AS ws FROM firsts)),
kept AS (
  SELECT a.* FROM bags a WHERE NOT EXISTS (FROM bags b WHERE b.doc_id = a.doc_id AND b.rk < a.rk AND len(a.gs) > 0 AND len(b.gs) > 0
    AND len(list_intersect(a.gs, b.gs)) >= least(len(a.gs), len(b.gs)) * 0.8))
SELECT doc_id, hl_id, text, importance, confidence, position::INTEGER AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS position FROM kept) WHERE position <= 10""",
)
QUERIES["merge_highlights"] = _merged
ORACLES["merge_highlights"] = ORACLES["merge_highlights_limited"].removesuffix(" WHERE position <= 10")

QUERIES["highlight_listing"] = lambda s, d: grounding.highlight_listing(highlights(s, d))
ORACLES["highlight_listing"] = with_ctes(
    HIGHLIGHTS_SQL,
    """SELECT doc_id, (row_number() OVER w)::INTEGER AS item_no, (row_number() OVER w) || '. [' || importance || ' / ' ||
  CASE WHEN coalesce(category, '') = '' THEN 'general' ELSE category END || '] ' || text AS line
FROM highlights WINDOW w AS (PARTITION BY doc_id ORDER BY hl_id)""",
)

QUERIES["summary_lines"] = lambda s, d: responses.summary_lines(task_responses(s, d))
ORACLES["summary_lines"] = with_ctes(
    TASKS_SQL,
    f""", content AS (
  SELECT doc_id, CASE lang WHEN 'de' THEN '{{"tasks": [ {{"action": "open"' || chr(10) || text
    WHEN 'en' THEN 'Here:' || chr(10) || '```json' || chr(10) || 'note {{"tasks":[{{"id":"T9","title":"' || w || '","owner":"","deadline":"Unspecified","priority":"urgent"}},{{"action":"' || w || ' x","owner":"Ann","deadline":"' || source || '","priority":"asap","category":"legal"}},{{}}]}} end' || chr(10) || '```'
    ELSE '1. ' || replace(text, chr(10), chr(10) || '- ') || chr(10) || '12) • short' || chr(10) || '2) -  ' || chr(10) || '  3. indented line' END AS c FROM tw),
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(c, '\\r?\\n'), lambda x: {trim_sql(f"regexp_replace(x, {q('^[-*•' + chr(92) + 'd.' + WS[1:-1] + ']+')}, '')")}), lambda x: x <> '') AS ls FROM content)
SELECT doc_id AS resp_id, generate_subscripts(ls, 1)::INTEGER AS line_no, unnest(ls) AS line FROM cut""".replace("{{", "{").replace("}}", "}"),
)


# ---- snippets -------------------------------------------------------------------------------------------------------


def snippets(s, d) -> DataFrame:
    """Per document: a verbatim piece, one changed in the middle, a short one, two plain words, part of a word."""
    t = F.col("text")
    third = F.floor(F.length(t) / 3).cast("int")
    pieces = F.array(
        F.substring(t, third + 1, F.lit(70)),
        F.concat(F.substring(t, third + 1, F.lit(40)), F.lit(" zebra crossing "), F.substring(t, third + 60, F.lit(40))),
        F.substring(t, third + 4, F.lit(12)),
        F.concat_ws(" ", F.get(F.split(t, " "), F.lit(2)), F.get(F.split(t, " "), F.lit(3))),
        F.substring(t, third + 2, F.lit(25)),
        F.concat(F.substring_index(t, " ", 3), F.lit(" qqq")),
    )
    return i.documents(s, d).select("doc_id", F.posexplode(pieces).alias("snippet_id", "snippet"))


SNIPPETS_SQL = """snippets AS (
  SELECT doc_id, unnest(ps) AS snippet, (generate_subscripts(ps, 1) - 1)::INTEGER AS snippet_id FROM (SELECT doc_id, [
    substring(text, t + 1, 70), substring(text, t + 1, 40) || ' zebra crossing ' || substring(text, t + 60, 40), substring(text, t + 4, 12),
    concat_ws(' ', string_split(text, ' ')[3], string_split(text, ' ')[4]), substring(text, t + 2, 25),
    array_to_string(string_split(text, ' ')[1:3], ' ') || ' qqq'] AS ps FROM (SELECT doc_id, text, length(text) // 3 AS t FROM documents)))"""


def locate_sql(snippets: str = "snippets", paras: str = "paras", name: str = "located") -> str:
    return f"""{name}_n AS (SELECT *, list_filter(string_split(needle, ' '), lambda w: w <> '') AS nw FROM (
  SELECT doc_id, snippet_id, snippet, {norm_sql('snippet')} AS needle FROM {snippets} WHERE length(snippet) >= 8) WHERE needle <> ''),
{name}_h AS (SELECT *, list_filter(string_split(hay, ' '), lambda w: w <> '') AS hw FROM (
  SELECT *, {norm_sql('text')} AS hay FROM {paras}) WHERE hay <> ''),
{name}_s AS (
  SELECT n.doc_id, n.snippet_id, n.snippet, n.needle, h.page, h.section, h.paragraph_index, h.text, h.hay,
    CASE WHEN contains(h.hay, n.needle) THEN length(n.needle)
      WHEN len(n.nw) < 4 OR len(h.hw) < 4 THEN len(list_filter(n.nw, lambda w: list_contains(h.hw, w)))
      ELSE 4 * len(list_intersect({shingles_sql('n.nw')}, {shingles_sql('h.hw')})) END AS score
  FROM {name}_n n JOIN {name}_h h USING (doc_id)),
{name}_b AS (SELECT * FROM {name}_s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, snippet_id ORDER BY score DESC, paragraph_index) = 1),
{name}_a AS (SELECT *, greatest(0, floor((strpos(hay, needle) - 1) / length(hay) * length(text))::BIGINT - 20) AS start FROM {name}_b WHERE score >= least(length(needle) * 0.25, 20)),
{name} AS (
  SELECT doc_id, snippet_id, page, section, paragraph_index, {trim_sql("CASE WHEN strpos(hay, needle) = 0 THEN substring(text, 1, 200) ELSE substring(text, start + 1, length(snippet) + 40) END")} AS snippet,
    score::INTEGER AS score FROM {name}_a)"""


def paras(s, d) -> DataFrame:
    return structure.paragraphs(headed_pages(s, d))


PARAS_SQL = HEADED_PAGES_SQL + ",\n" + paragraphs_sql("headed_pages")

QUERIES["locate_snippets"] = lambda s, d: grounding.locate_snippets(snippets(s, d), paras(s, d))
ORACLES["locate_snippets"] = with_ctes([PARAS_SQL, SNIPPETS_SQL, locate_sql()], "SELECT * FROM located")


def _referenced(s, d):
    """The snippets as highlights; every fifth already has a page and every fifth has only a snippet to go by."""
    rows = snippets(s, d)
    k = (F.col("doc_id") + F.col("snippet_id")) % 5
    null = F.lit(None)
    ref = F.struct(
        F.when(k == 0, 7).alias("page"), null.cast("string").alias("section"), null.cast("int").alias("paragraph_index"),
        F.when(k == 1, F.col("snippet")).alias("snippet"),
    )
    return rows.select("doc_id", F.col("snippet_id").alias("hl_id"), F.when(k == 1, "").otherwise(F.col("snippet")).alias("text"), ref.alias("source_reference"))


QUERIES["enrich_highlights"] = lambda s, d: grounding.enrich_highlights(_referenced(s, d), paras(s, d)).select("doc_id", "hl_id", "text", "source_reference.*")
ENRICHED_SQL = """enriched AS (
  SELECT s.doc_id, s.snippet_id AS hl_id, CASE k WHEN 1 THEN '' ELSE s.snippet END AS text, CASE k WHEN 0 THEN 7 ELSE l.page END AS page,
    CASE WHEN k <> 0 THEN l.section END AS section, CASE WHEN k <> 0 THEN l.paragraph_index END AS paragraph_index,
    CASE WHEN k = 0 THEN NULL WHEN l.doc_id IS NOT NULL THEN l.snippet WHEN k = 1 THEN s.snippet END AS snippet
  FROM (SELECT *, (doc_id + snippet_id) % 5 AS k FROM snippets) s LEFT JOIN located l ON l.doc_id = s.doc_id AND l.snippet_id = s.snippet_id)"""
ORACLES["enrich_highlights"] = with_ctes([PARAS_SQL, SNIPPETS_SQL, locate_sql(), ENRICHED_SQL], "SELECT * FROM enriched")

QUERIES["page_density"] = lambda s, d: grounding.page_density(grounding.enrich_highlights(_referenced(s, d), paras(s, d)))
ORACLES["page_density"] = with_ctes(
    [PARAS_SQL, SNIPPETS_SQL, locate_sql(), ENRICHED_SQL],
    "SELECT doc_id, page, count(*) AS count FROM enriched WHERE page IS NOT NULL GROUP BY doc_id, page",
)


# ---- questions ------------------------------------------------------------------------------------------------------

SHAPES = 8


def quiz(s, d) -> DataFrame:
    """Eight questions per document that fail, or pass, in every way there is."""
    t = F.col("text")
    src = F.substring(t, F.floor(F.length(t) / 2).cast("int") + 1, F.lit(80))
    ans = F.substring_index(trim_ws(src), " ", 1)
    base = i.documents(s, d).select("doc_id", "lang", src.alias("src"), ans.alias("ans"), F.explode(F.sequence(F.lit(0), F.lit(SHAPES - 1))).alias("pos"))
    p = F.col("pos")
    return base.select(
        "doc_id",
        "pos",
        F.when(p == 2, "own").otherwise(F.lit(None)).cast("string").alias("id"),
        F.when(p.isin(0, 3), "mcq").when(p.isin(1, 5), "true_false").when(p == 6, "essay").otherwise(F.lit(None)).cast("string").alias("type"),
        F.when(p == 4, " ").otherwise(F.concat(F.lit(" What about "), "ans", F.lit("? "))).alias("question"),
        F.when(p.isin(0, 3, 6), F.array(F.lit("none"), F.when(p == 3, F.lit("other")).otherwise(trim_ws(F.col("ans"))), F.lit("a"), F.lit("b"), F.lit("c"))).alias("options"),
        F.when(p == 1, "false").when(p == 5, "maybe").otherwise(F.col("ans")).alias("answer"),
        F.lit(None).cast("string").alias("explanation"),
        F.when(p == 7, F.lit("utterly unrelated gibberish sentence here")).when(p == 2, F.concat(F.substring("src", 1, 60), F.lit(" xyzzy"))).otherwise(F.col("src")).alias("source_text"),
        F.when(p % 2 == 0, "hard").otherwise("extreme").alias("difficulty"),
        F.when(p == 1, " Topic ").otherwise("").alias("topic"),
    )


_SRC = trim_sql("src")
QUIZ_SQL = f"""base AS (
  SELECT doc_id, text, {_SRC} AS src, {trim_sql(f"split_part({_SRC}, ' ', 1)")} AS ans,
    {trim_sql("substring(src, 1, 60) || ' xyzzy'")} AS src2, unnest(range(0, 8))::INTEGER AS pos
  FROM (SELECT doc_id, text, substring(text, length(text) // 2 + 1, 80) AS src FROM documents)),
quiz AS (
  SELECT doc_id, text, pos, CASE pos WHEN 2 THEN 'own' END AS id,
    CASE WHEN pos IN (0, 3) THEN 'mcq' WHEN pos IN (1, 5) THEN 'true_false' WHEN pos = 6 THEN 'mcq' ELSE 'short' END AS type,
    CASE pos WHEN 4 THEN '' ELSE {trim_sql("' What about ' || split_part(src, ' ', 1) || '? '")} END AS question,
    CASE WHEN pos IN (0, 6) THEN ['none', ans, 'a', 'b', 'c'] WHEN pos = 3 THEN ['none', 'other', 'a', 'b', 'c'] END AS options,
    CASE pos WHEN 1 THEN 'false' WHEN 5 THEN 'maybe' ELSE ans END AS answer,
    CASE pos WHEN 7 THEN 'utterly unrelated gibberish sentence here' WHEN 2 THEN src2 ELSE src END AS source_text,
    CASE WHEN pos % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty, CASE pos WHEN 1 THEN 'Topic' ELSE 'General' END AS topic FROM base),
folded AS (
  SELECT q.*, h.hay, {norm_sql('source_text')} AS s, {norm_sql('answer')} AS a FROM quiz q JOIN (SELECT doc_id, {norm_sql('text')} AS hay FROM documents) h USING (doc_id))"""


def _fuzzy_sql(hay: str, nd: str) -> str:
    toks = f"list_filter(string_split({nd}, ' '), lambda w: length(w) > 3)"
    return f"""CASE WHEN {hay} = '' OR {nd} = '' THEN false WHEN contains({hay}, {nd}) THEN true WHEN length({nd}) < 8 THEN false
      WHEN len({toks}) = 0 THEN contains({hay}, substring({nd}, 1, greatest(6, floor(length({nd}) * 0.7)::INTEGER)))
      ELSE len(list_filter({toks}, lambda t: contains({hay}, t))) / len({toks}) >= 0.55 END"""


CHECKED_SQL = f"""{QUIZ_SQL},
checked AS (
  SELECT *, CASE WHEN question = '' OR answer = '' OR source_text = '' THEN 'missing required fields'
    WHEN NOT ({_fuzzy_sql('hay', 's')}) THEN 'source_text not in document'
    WHEN type = 'mcq' AND NOT list_contains(options, answer) THEN 'answer not among options'
    WHEN type = 'mcq' AND NOT ({_fuzzy_sql('s', 'a')}) AND NOT ({_fuzzy_sql('hay', 'a')}) THEN 'mcq answer not in document'
    WHEN type = 'true_false' AND answer NOT IN ('True', 'False', 'true', 'false') THEN 'invalid true_false answer' END AS reason
  FROM folded)"""


def _validated(s, d):
    return grounding.validate_questions(quiz(s, d), i.documents(s, d))


QUERIES["validate_questions"] = lambda s, d: _validated(s, d)[0].withColumn("options", F.array_join("options", "|"))
ORACLES["validate_questions"] = with_ctes(
    CHECKED_SQL,
    """SELECT doc_id, pos, coalesce(id, 'q' || row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS id, type, question,
  array_to_string(options, '|') AS options, CASE type WHEN 'true_false' THEN 'False' ELSE answer END AS answer, '' AS explanation, source_text, difficulty, topic
FROM checked WHERE reason IS NULL""",
)
QUERIES["dropped_questions"] = lambda s, d: _validated(s, d)[1]
ORACLES["dropped_questions"] = with_ctes(
    CHECKED_SQL, "SELECT doc_id, pos, substring(question, 1, 60) AS question, reason FROM checked WHERE reason IS NOT NULL"
)


def _references(s, d):
    out = grounding.question_references(_validated(s, d)[0], paras(s, d))
    return out.select("doc_id", "pos", "source_reference.*")


QUERIES["question_references"] = _references
ORACLES["question_references"] = with_ctes(
    [PARAS_SQL, CHECKED_SQL, "asked AS (SELECT doc_id, pos AS snippet_id, source_text AS snippet FROM checked WHERE reason IS NULL)", locate_sql("asked")],
    """SELECT a.doc_id, a.snippet_id AS pos, l.page, l.section, l.paragraph_index,
  CASE WHEN coalesce(l.snippet, '') = '' THEN substring(a.snippet, 1, 80) ELSE l.snippet END AS snippet
FROM asked a LEFT JOIN located l ON l.doc_id = a.doc_id AND l.snippet_id = a.snippet_id""",
)


def _summary(s, d):
    requests = i.documents(s, d).select("doc_id", pick(["quick", "standard", "deep", "huge"], F.col("doc_id")).alias("length"))
    return grounding.question_summary(quiz(s, d), _validated(s, d)[0], requests)


QUERIES["question_summary"] = _summary
ORACLES["question_summary"] = with_ctes(
    CHECKED_SQL,
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 2 THEN 15 ELSE 10 END AS requested_count,
  count(*) FILTER (WHERE reason IS NULL) AS valid_count, count(*) FILTER (WHERE reason IS NULL) = 0 AS insufficient FROM checked GROUP BY doc_id""",
)


# ---- OCR results ----------------------------------------------------------------------------------------------------


def _ocr(s, d):
    pages = i.doc_pages(s, d, 700)
    n = F.col("doc_id") + F.col("page")
    results = pages.select(
        "doc_id", "page", F.when(n % 4 != 0, F.col("text")).alias("text"), F.when(n % 4 == 0, "Failed to process page").alias("error")
    )
    langs = F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(k).alias("k")) for k, x in enumerate(["deu", "fra", "spa", "eng", "ita"])])
    trials = i.documents(s, d).select("doc_id", F.explode(langs).alias("t")).select(
        "doc_id", F.col("t.lang").alias("lang"), ((F.col("doc_id") * (F.col("t.k") + 1)) % 3 * (F.col("doc_id") % 5)).cast("double").alias("confidence")
    )
    return responses.ocr_rollup(trials, results)


QUERIES["ocr_rollup"] = _ocr
ORACLES["ocr_rollup"] = with_ctes(
    i.doc_pages_sql("p", 700),
    f""", trials AS (
  SELECT doc_id, lang, o, ((doc_id * (k + 1)) % 3 * (doc_id % 5))::DOUBLE AS confidence
  FROM (SELECT doc_id FROM documents), (VALUES ('deu', 0, 4), ('fra', 1, 3), ('spa', 2, 2), ('eng', 3, 1)) v(lang, k, o)),
best AS (SELECT doc_id, arg_max(lang, confidence * 10 - o) AS lang, max(confidence) AS c FROM trials GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN any_value(b.c) > 0 THEN any_value(b.lang) ELSE 'eng' END AS language, 0 AS part,
  {trim_sql("coalesce(string_agg(chr(10) || '--- Page ' || p.page || ' ---' || chr(10) || p.text || chr(10), '' ORDER BY p.page) FILTER (WHERE (p.doc_id + p.page) % 4 <> 0), '')")} AS text,
  count(*) AS total_pages, count(*) FILTER (WHERE (p.doc_id + p.page) % 4 = 0) AS failed_pages
FROM p JOIN best b USING (doc_id) GROUP BY p.doc_id""",
)
