"""Parsing tables of model responses, and merging the parts of chunked runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.blocks import number_rows
from leafmill.functions.text import WS, last_index, let, lines_of, nonempty, trim_ws

# Fixed values.
NOT_FOUND = "couldn't find information"
PRIORITIES = ("urgent", "high", "medium", "low")
BLANK_DEADLINES = ("Not specified", "Unspecified")
MIN_TASK_CHARS = 10
SUMMARY_LINES = 5
LIST_CAPS = {"insights": 8, "strengths": 6, "weaknesses": 6, "recommendations": 6, "topics": 6}
OCR_LANGUAGES = ("eng", "spa", "fra", "deu")
TASK_FIELDS = ("id", "action", "owner", "deadline", "priority", "context", "category")


def fenced_json(content: Column) -> Column:
    """Body of the first code fence, else the whole text."""
    pattern = f"```(?:json)?{WS}*([\\s\\S]*?){WS}*```"
    return F.when(F.rlike(content, F.lit(pattern)), F.regexp_extract(content, pattern, 1)).otherwise(content)


def parse_responses(responses: DataFrame, mode: str = "qa") -> DataFrame:
    """(resp_id, doc_id, answer, citations, found).

    'qa' takes any valid JSON and otherwise the raw text. 'chat' wants JSON with an answer and otherwise takes the
    raw text with its inline (Page N) or (Chapter N) citations.
    """
    json = fenced_json(F.col("content"))
    valid = F.try_parse_json(json).isNotNull()
    body = F.from_json(json, "answer string, citations array<struct<page:int,quote:string>>, found boolean")
    parsed = responses.select("resp_id", "doc_id", "content", valid.alias("valid"), body.alias("b"))
    none = F.array().cast("array<struct<page:int,quote:string>>")
    listed = F.coalesce("b.citations", none)
    stated = F.coalesce("b.found", F.lit(True))
    if mode == "qa":
        answer = F.when(F.col("valid"), nonempty(F.col("b.answer"), F.col("content"))).otherwise(F.col("content"))
        citations = F.when(F.col("valid"), listed).otherwise(none)
        found = F.when(F.col("valid"), stated).otherwise(True)
    else:
        structured = F.col("valid") & (F.coalesce("b.answer", F.lit("")) != "")
        numbers = F.array_distinct(
            F.transform(F.regexp_extract_all("content", F.lit(rf"(?i)\((?:Page|Chapter){WS}+(\d+)\)"), F.lit(1)), lambda n: n.cast("int"))
        )
        inline = F.transform(numbers, lambda n: F.struct(n.alias("page"), F.lit("").alias("quote")))
        answer = F.when(structured, F.col("b.answer")).otherwise(F.col("content"))
        citations = F.when(structured, listed).otherwise(inline)
        found = F.when(structured, stated).otherwise(~F.contains(F.lower("content"), F.lit(NOT_FOUND)))
    return parsed.select("resp_id", "doc_id", answer.alias("answer"), citations.alias("citations"), found.alias("found"))


def citation_coverage(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, citations, page_exists): how often each page is cited."""
    cited = (
        parsed.select("doc_id", F.explode("citations.page").alias("page"))
        .groupBy("doc_id", "page")
        .agg(F.count(F.lit(1)).alias("citations"))
    )
    known = pages.select("doc_id", "page", F.lit(True).alias("page_exists"))
    return cited.join(known, ["doc_id", "page"], "left").fillna(False, ["page_exists"])


# ---- tasks ----------------------------------------------------------------------------------------------------------


def normalise_tasks(responses: DataFrame) -> DataFrame:
    """(resp_id, doc_id, task_no, id, action, owner, deadline, priority, context, category)."""
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    raw = trim_ws(F.when(F.rlike("content", F.lit(fence)), F.regexp_extract("content", fence, 1)).otherwise(F.col("content")))

    def outermost(text: Column) -> Column:
        start, end = F.instr(text, "{"), last_index(text, "}") + 1
        return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1)).otherwise(text)

    fields = ", ".join(f"{f}: string" for f in (*TASK_FIELDS, "title"))
    json = let(raw, outermost)
    listed = F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, f"tasks array<struct<{fields}>>")["tasks"])
    marked = responses.select("resp_id", "doc_id", "content", listed.alias("tasks"))

    t = F.col("t")
    deadline = nonempty(t["deadline"], F.lit(""))
    from_json = (
        marked.filter(F.col("tasks").isNotNull())
        .select("resp_id", "doc_id", F.posexplode("tasks").alias("k", "t"))
        .select(
            "resp_id",
            "doc_id",
            (F.col("k") + 1).alias("task_no"),
            nonempty(t["id"], F.concat(F.lit("task-"), (F.col("k") + 1).cast("string"))).alias("id"),
            nonempty(t["action"], nonempty(t["title"], F.lit("Untitled task"))).alias("action"),
            nonempty(t["owner"], F.lit("Unassigned")).alias("owner"),
            F.when(deadline.isin(*BLANK_DEADLINES), "").otherwise(deadline).alias("deadline"),
            F.when(t["priority"].isin(*PRIORITIES), t["priority"]).otherwise("medium").alias("priority"),
            nonempty(t["context"], F.lit("")).alias("context"),
            nonempty(t["category"], F.lit("other")).alias("category"),
        )
    )
    lines = F.filter(lines_of(F.col("content")), lambda line: F.length(trim_ws(line)) > MIN_TASK_CHARS)
    action = trim_ws(F.regexp_replace(F.regexp_replace("line", r"^\d+[.)]\s*", ""), r"^[-*•]\s*", ""))
    from_text = (
        marked.filter(F.col("tasks").isNull())
        .select("resp_id", "doc_id", F.posexplode(lines).alias("k", "line"))
        .select(
            "resp_id",
            "doc_id",
            (F.col("k") + 1).alias("task_no"),
            F.concat(F.lit("task-"), (F.col("k") + 1).cast("string")).alias("id"),
            action.alias("action"),
            F.lit("Unassigned").alias("owner"),
            F.lit("").alias("deadline"),
            F.lit("medium").alias("priority"),
            F.lit("").alias("context"),
            F.lit("other").alias("category"),
        )
        .filter(F.length("action") > 0)
    )
    return from_json.unionByName(from_text)


def first_task(responses: DataFrame, texts: DataFrame) -> DataFrame:
    """One task per converted passage: the first parsed one, else the passage itself. `texts` is (resp_id, text)."""
    row = F.struct("id", "action", "owner", "deadline", "priority", "context", "category")
    firsts = normalise_tasks(responses).groupBy("resp_id").agg(F.min_by(row, "task_no").alias("t"))
    fallback = F.struct(
        F.lit(None).cast("string").alias("id"), F.col("text").alias("action"), F.lit(None).cast("string").alias("owner"),
        F.lit(None).cast("string").alias("deadline"), F.lit("medium").alias("priority"), F.lit(None).cast("string").alias("context"),
        F.lit("follow-up").alias("category"),
    )
    return texts.join(firsts, "resp_id", "left").select("resp_id", F.coalesce("t", fallback).alias("t")).select("resp_id", "t.*")


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks of all parts of a document without repeats of (action, owner), renumbered in (part, task_no) order."""
    same = ["doc_id", "_action", "_owner"]
    keyed = tasks.withColumn("_action", F.lower("action")).withColumn("_owner", F.lower("owner"))
    firsts = keyed.groupBy(*same).agg(F.min(F.struct("part", "task_no")).alias("f")).select("doc_id", "f.part", "f.task_no")
    kept = tasks.join(firsts, ["doc_id", "part", "task_no"], "left_semi")
    numbered = number_rows(kept, ["doc_id"], ["part", "task_no"], F.col("part").cast("bigint"), "_n")
    return numbered.withColumn("id", F.concat(F.lit("task-"), F.col("_n").cast("string"))).drop("_n")


def merge_analyses(parts: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """One analysis per document: mean sentiment score, lists joined without repeats.

    Lists are whole unless `caps` (suggested: LIST_CAPS) gives some of them a length.

    `parts` is (doc_id, part, sentiment_score, insights, strengths, weaknesses, recommendations, topics).
    """
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.lit((caps or {}).get(f)).cast("int").alias("cap"), F.col(f).alias("xs")) for f in LIST_CAPS])
    items = (
        parts.select("doc_id", "part", F.explode(lists).alias("l"))
        .select("doc_id", "part", F.col("l.field").alias("field"), F.col("l.cap").alias("cap"), F.posexplode("l.xs").alias("k", "item"))
        .groupBy("doc_id", "field", "cap", "item")
        .agg(F.min(F.struct("part", "k")).alias("seen"))
    )
    rank = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("seen"))
    top = items.withColumn("r", rank).filter(F.col("cap").isNull() | (F.col("r") <= F.col("cap")))
    none = F.array().cast("array<string>")
    merged = top.groupBy("doc_id").agg(
        *[
            F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("r", "item")))), lambda x: x["item"]).alias(f)
            for f in LIST_CAPS
        ]
    )
    scores = parts.groupBy("doc_id").agg(F.avg("sentiment_score").alias("sentiment_score"), F.count(F.lit(1)).alias("parts"))
    joined = scores.join(merged, "doc_id", "left")
    return joined.select("doc_id", "parts", "sentiment_score", *[F.coalesce(f, none).alias(f) for f in LIST_CAPS])


def summary_lines(responses: DataFrame, n: int | None = None) -> DataFrame:
    """(resp_id, line_no, line): lines of a free-text summary without bullets and numbers, all or the first `n`
    (suggested: SUMMARY_LINES)."""
    stripped = F.transform(
        F.split(F.coalesce("content", F.lit("")), r"\r?\n"), lambda line: trim_ws(F.regexp_replace(line, f"^[-*•\\d.{WS[1:-1]}]+", ""))
    )
    lines = F.filter(stripped, lambda line: F.length(line) > 0)
    lines = lines if n is None else F.slice(lines, 1, n)
    return responses.select("resp_id", F.posexplode(lines).alias("k", "line")).select("resp_id", (F.col("k") + 1).alias("line_no"), "line")


# ---- OCR results ----------------------------------------------------------------------------------------------------


def ocr_language(trials: DataFrame) -> DataFrame:
    """(doc_id, language): most confident trial, the earlier language on ties, English when nothing is confident."""
    order = F.array_position(F.array(*[F.lit(x) for x in OCR_LANGUAGES]), F.col("lang"))
    usable = F.when((F.col("confidence") > 0) & (order > 0), F.col("lang"))
    best = F.max_by(usable, F.when(usable.isNotNull(), F.struct(F.col("confidence"), (-order).alias("o"))))
    return trials.groupBy("doc_id").agg(F.coalesce(best, F.lit(OCR_LANGUAGES[0])).alias("language"))


def ocr_rollup(trials: DataFrame, pages: DataFrame, pages_per_part: int = 4096) -> DataFrame:
    """(doc_id, language, part, text, total_pages, failed_pages): page texts with page markers, failures left out."""
    block = F.concat(F.lit("\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    ok = F.col("error").isNull()
    ordered = F.sort_array(F.collect_list(F.when(ok, F.struct("page", block.alias("block")))))
    parts = (
        pages.withColumn("part", F.floor((F.col("page") - 1) / pages_per_part).cast("int"))
        .groupBy("doc_id", "part")
        .agg(
            trim_ws(F.array_join(ordered.getField("block"), "")).alias("text"),
            F.count(F.lit(1)).alias("total_pages"),
            F.count_if(~ok).alias("failed_pages"),
        )
    )
    return parts.join(ocr_language(trials), "doc_id", "left").fillna(OCR_LANGUAGES[0], ["language"])
