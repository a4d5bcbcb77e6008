"""Annotation groups, form tables, document profiles and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import nonempty, trim_ws

# Fixed values.
ANNOTATION_TYPES = ("Highlight", "Underline", "StrikeOut", "FreeText", "Text", "Square")
NOTE_TYPES = ("Text", "FreeText")
COLOR_BOXES = (
    ("yellow", (0.9, 1.1), (0.9, 1.1), (-0.1, 0.2)),
    ("green", (-0.1, 0.3), (0.6, 1.1), (-0.1, 0.4)),
    ("blue", (-0.1, 0.4), (0.4, 1.1), (0.6, 1.1)),
    ("pink", (0.8, 1.1), (0.4, 0.8), (0.6, 1.1)),
    ("red", (0.7, 1.1), (-0.1, 0.3), (-0.1, 0.3)),
    ("orange", (0.8, 1.1), (0.4, 0.7), (-0.1, 0.2)),
)
FIELD_TYPES = ("checkbox", "radio", "dropdown", "listbox", "text")
TRUE_VALUES = ("true", "yes", "1")
LARGE_FILE_BYTES = 50 * 1024 * 1024


def color_name(color: Column) -> Column:
    """Name of the first box the RGB colour lies in; fewer than three components are unknown, no box is custom."""
    r, g, b = (color[k] for k in range(3))
    out = F.when(color.isNull() | (F.size(color) < 3), "unknown")
    for name, rr, gg, bb in COLOR_BOXES:
        out = out.when(r.between(*rr) & g.between(*gg) & b.between(*bb), name)
    return out.otherwise("custom")


def annotation_table(annotations: DataFrame) -> DataFrame:
    """Wanted annotation types with their display text, note, author, colour name and date.

    `annotations` is (doc_id, page, seq, type, contents, rich, author, color, date).
    """
    contents = F.coalesce("contents", F.lit(""))
    rich = trim_ws(F.regexp_replace(F.coalesce("rich", F.lit("")), "<[^>]+>", ""))
    shown = nonempty(rich, nonempty(contents, F.concat(F.lit("["), F.col("type"), F.lit(" annotation]"))))
    return annotations.filter(F.col("type").isin(*ANNOTATION_TYPES)).select(
        "doc_id",
        "page",
        "seq",
        "type",
        shown.alias("text"),
        F.when(F.col("type").isin(*NOTE_TYPES), contents).otherwise("").alias("note"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        color_name(F.col("color")).alias("color_name"),
        F.try_to_timestamp(F.regexp_extract("date", r"^(?:D:)?(\d{14})", 1), F.lit("yyyyMMddHHmmss")).alias("date"),
    )


def group_annotations(annotations: DataFrame, by: str = "page", items_per_part: int = 4096) -> DataFrame:
    """(doc_id, label, part, items): annotations of each page, colour or author in input order.

    A group is handed out in parts of consecutive input positions, so no part grows with the group.
    """
    table = annotation_table(annotations)
    label = {"page": F.concat(F.lit("Page "), F.col("page").cast("string")), "color": F.col("color_name"), "author": nonempty(F.col("author"), F.lit("Unknown Author"))}[by]
    sort = F.col("page") if by == "page" else F.lit(0)
    item = F.struct("page", "seq", "type", "text", "note", "author", "color_name")
    return (
        table.groupBy("doc_id", label.alias("label"), sort.alias("_sort"), F.floor(F.col("seq") / items_per_part).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .orderBy("doc_id", "_sort", "label", "part")
        .drop("_sort")
    )


def annotation_breakdown(annotations: DataFrame) -> DataFrame:
    """(doc_id, type, count, pages): per document and type, with totals per document and for the corpus as null keys.

    A page is a page of one document: two documents with a first page each have two.
    """
    wanted = annotations.filter(F.col("type").isin(*ANNOTATION_TYPES)).withColumns({"_doc": F.col("doc_id"), "_page": F.col("page")})
    return wanted.rollup("doc_id", "type").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("_doc", "_page").alias("pages"))


# ---- forms ----------------------------------------------------------------------------------------------------------


def form_table(fields: DataFrame) -> DataFrame:
    """(doc_id, name, type, value, options): cleaned field rows. `values` holds the selected values."""
    kind = F.when(F.col("type").isin(*FIELD_TYPES), F.col("type")).otherwise("text")
    value = F.coalesce(F.array_join("values", ", "), F.lit(""))
    return fields.select("doc_id", "name", kind.alias("type"), F.when(value == "N/A", "").otherwise(value).alias("value"), "options")


def form_counts(fields: DataFrame) -> DataFrame:
    return form_table(fields).groupBy("doc_id").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("value") != "").alias("filled"))


def fill_form(fields: DataFrame, values: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(filled fields, unknown names): `values` is (doc_id, name, value). A check box is on for true, yes or 1 only.

    Of several values for one field the last by the column `order` counts, without one the largest.
    """
    given = values.groupBy("doc_id", "name").agg(F.max_by("value", F.col(order or "value")).alias("_given"))
    joined = form_table(fields).join(given, ["doc_id", "name"], "left")
    ticked = F.when(F.col("_given").isin(*TRUE_VALUES), "true").otherwise("false")
    new = F.when(F.col("_given").isNull(), F.col("value")).when(F.col("type") == "checkbox", ticked).otherwise(F.col("_given"))
    unknown = given.join(fields.select("doc_id", "name"), ["doc_id", "name"], "left_anti").select("doc_id", "name")
    return joined.withColumn("value", new).drop("_given"), unknown


def form_records(fields: DataFrame, names: list[str]) -> DataFrame:
    """One wide record per document for the named fields."""
    return form_table(fields).groupBy("doc_id").pivot("name", names).agg(F.first("value"))


# ---- documents ------------------------------------------------------------------------------------------------------

META_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer")


def doc_profile(docs: DataFrame, pages: DataFrame, fields: DataFrame, objects: DataFrame, annotations: DataFrame, max_fonts: int | None = None) -> DataFrame:
    """One row per document; counts that are zero are null.

    `docs` is (doc_id, size, version, META_FIELDS…), `pages` (doc_id, page, width, height, rotation), `objects`
    (doc_id, kind, name). Every input is aggregated before it is joined.
    """
    zero_null = lambda c: F.nullif(c, F.lit(0).cast("bigint"))
    first = F.min_by(F.struct("width", "height", "rotation"), "page")
    page_side = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), first.alias("p"))
    fonts = objects.filter(F.col("kind") == "font").groupBy("doc_id", "name").agg(F.lit(1).alias("one"))
    font_rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))
    listed = fonts if max_fonts is None else fonts.withColumn("r", font_rank).filter(F.col("r") <= max_fonts)
    names = listed.groupBy("doc_id").agg(F.sort_array(F.collect_list("name")).alias("font_names"))
    font_count = fonts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("font_count"))
    others = objects.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "image").alias("image_count"), (F.count_if(F.col("kind") == "filespec") > 0).alias("has_embedded_files")
    )
    form = fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("form_field_count"))
    ann = annotations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("annotation_count"))
    out = docs
    for side in (page_side, others, font_count, names, form, ann):
        out = out.join(side, "doc_id", "left")
    return out.select(
        "doc_id",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.col("size").alias("file_size"),
        F.col("version").alias("pdf_version"),
        F.round("p.width").cast("int").alias("page_width"),
        F.round("p.height").cast("int").alias("page_height"),
        F.nullif(F.col("p.rotation"), F.lit(0)).alias("page_rotation"),
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in META_FIELDS],
        (F.coalesce("form_field_count", F.lit(0)) > 0).alias("has_form"),
        F.col("form_field_count"),
        F.coalesce("has_embedded_files", F.lit(False)).alias("has_embedded_files"),
        zero_null(F.col("image_count")).alias("image_count"),
        F.col("font_count"),
        F.col("font_names"),
        F.col("annotation_count"),
    )


def doc_issues(profile: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(doc_id, valid, issues): quality rules in fixed order. `errors` is (doc_id, message) of unreadable documents."""
    if errors is not None:
        profile = profile.join(errors.select("doc_id", "message"), "doc_id", "left")
    else:
        profile = profile.withColumn("message", F.lit(None).cast("string"))
    ok = F.col("message").isNull()
    rules = F.array(
        F.when(ok & (F.col("page_count") == 0), "Document has no pages"),
        F.when(ok & F.col("title").isNull(), "Missing title metadata"),
        F.when(ok & (F.col("file_size") > LARGE_FILE_BYTES), "File size exceeds 50MB - may cause performance issues"),
        F.when(~ok, F.concat(F.lit("Parse error: "), F.col("message"))),
    )
    return profile.select("doc_id", ok.alias("valid"), F.filter(rules, lambda r: r.isNotNull()).alias("issues"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("documents"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, rotation), sizes rounded."""
    return pages.select("doc_id", "page", F.round("width").cast("int").alias("width"), F.round("height").cast("int").alias("height"), "rotation")
