"""Search, replace, redaction checks, change audits.

Terms are either a list of strings, applied to every document, or a table (doc_id, term) joined by document; they never
meet the text in a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.blocks import block_of, prefix_sums, spread_join
from leafmill.functions.text import is_blank, let, lines_of, quote_regex

Terms = list[str] | DataFrame


def with_terms(rows: DataFrame, terms: Terms, spread: str | None = None) -> DataFrame:
    """Rows with the array `terms` to look for."""
    if isinstance(terms, list):
        return rows.withColumn("terms", F.array(*[F.lit(t) for t in terms]))
    per_doc = terms.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    if spread:
        return spread_join(rows, per_doc, ["doc_id"], F.col(spread))
    return rows.join(per_doc, "doc_id")


def _fold(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def grep_lines(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, term, line_no, line): lines that contain a term, case aside."""
    looked = with_terms(docs.select("doc_id", "text"), terms)
    # documents without any hit are gone before their lines are exploded
    any_hit = F.exists("terms", lambda t: F.contains(F.lower("text"), F.lower(t)))
    lines = looked.filter(any_hit).select("doc_id", "terms", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    hits = F.filter("terms", lambda t: F.contains(F.lower("line"), F.lower(t)))
    return lines.select("doc_id", F.explode(hits).alias("term"), (F.col("pos") + 1).alias("line_no"), "line")


def match_starts(line: Column, needle: Column, case_sensitive: bool = False) -> Column:
    """0-based starts of all occurrences, overlapping ones too, from one pass of splitting at look-ahead matches."""
    hay, pin = _fold(line, case_sensitive), _fold(needle, case_sensitive)
    pieces = F.split(hay, F.concat(F.lit("(?="), quote_regex(pin), F.lit(")")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    def drop_lead(starts: Column) -> Column:
        # the first piece starts a match only when the line itself starts with the needle
        return F.when(F.startswith(hay, pin), starts).otherwise(F.slice(starts, F.lit(2), F.size(starts)))

    def as_written(starts: Column) -> Column:
        # lower-casing makes some characters longer; then a start counts the characters of the line that end before it
        ends = F.transform(F.sequence(F.lit(1), F.length(line)), lambda k: F.length(F.lower(F.substring(line, F.lit(1), k))))
        moved = F.transform(starts, lambda at: F.size(F.filter(ends, lambda e: e <= at)))
        return F.when(F.length(hay) == F.length(line), starts).otherwise(moved)

    found = let(F.aggregate(pieces, start, step)["starts"], lambda starts: as_written(drop_lead(starts)))
    return F.when(F.contains(hay, pin), found).otherwise(F.array().cast("array<int>"))


def find_matches(lines: DataFrame, terms: Terms, case_sensitive: bool = False) -> DataFrame:
    """Lines' columns plus (term, start, matched): every occurrence with its text as written."""
    wanted = with_terms(lines, terms, "line_no").withColumn("term", F.explode("terms")).drop("terms")
    hit = F.contains(_fold(F.col("text"), case_sensitive), _fold(F.col("term"), case_sensitive))
    starts = match_starts(F.col("text"), F.col("term"), case_sensitive)
    return (
        wanted.filter(hit & (F.length("term") > 0))
        .withColumn("start", F.explode(starts))
        .withColumn("matched", F.substring(F.col("text"), F.col("start") + 1, F.length("term")))
    )


def match_regions(lines: DataFrame, terms: Terms, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, page, line_no, term, start, region, x, y, w, h): boxes under each match.

    `lines` come from `items_to_lines`. Items are joined by one blank; a match covers the items whose character range
    overlaps its own, cut to the overlap at equal character widths.
    """
    matches = find_matches(lines, terms, case_sensitive)
    ends = F.aggregate(
        "items",
        F.array().cast("array<int>"),
        lambda acc, it: F.array_append(
            acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)) + F.length(it["text"])
        ),
    )
    spans = F.zip_with("items", ends, lambda it, e: F.struct(it.alias("it"), (e - F.length(it["text"])).alias("s"), e.alias("e")))
    first, last = F.col("start"), F.col("start") + F.length("term")
    hit = F.filter(spans, lambda p: (p["e"] > first) & (p["s"] < last))
    rows = matches.select("doc_id", "page", "line_no", "term", "start", F.length("term").alias("n"), F.posexplode(hit).alias("region", "p"))
    lo = F.greatest(F.col("start"), F.col("p.s")) - F.col("p.s")
    hi = F.least(F.col("start") + F.col("n"), F.col("p.e")) - F.col("p.s")
    char_w = F.col("p.it.w") / F.length("p.it.text")
    return rows.select(
        "doc_id", "page", "line_no", "term", "start", "region",
        (F.col("p.it.x") + lo * char_w).alias("x"),
        F.col("p.it.y").alias("y"),
        ((hi - lo) * char_w).alias("w"),
        F.col("p.it.h").alias("h"),
    )


def count_hits(blocks: DataFrame, terms: Terms, order: str = "block_no", content: str = "content") -> DataFrame:
    """(doc_id, block_no, term, hits, first_hit): non-overlapping hits per block.

    `first_hit` is the running number, from 0, of the block's first hit in its document.
    """
    looked = with_terms(blocks.select("doc_id", order, content), terms, order)
    rows = looked.withColumn("term", F.explode("terms")).filter(F.length("term") > 0)
    low, pin = F.lower(content), F.lower("term")
    gone = F.length(low) - F.length(F.replace(low, pin, F.lit("")))
    counted = rows.select("doc_id", order, "term", (gone / F.length(pin)).cast("int").alias("hits")).filter(F.col("hits") > 0)
    return prefix_sums(counted, ["doc_id", "term"], [order], {"first_hit": F.col("hits")}, block_of(order))


def replace_text(docs: DataFrame, search: str, replacement: str, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, text, replacements, status): text-level replace, left to right without overlap."""
    if not search:
        raise ValueError("search text is required")
    flag = "" if case_sensitive else "(?iu)"
    pattern = F.concat(F.lit(flag), quote_regex(F.lit(search)))
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    done = F.regexp_replace(F.col("text"), pattern, F.lit(literal))
    status = (
        F.when(is_blank(F.col("text")), "no extractable text")
        .when(F.col("replacements") == 0, "no matches")
        .when(F.col("_old") == F.col("text"), "unchanged")
        .otherwise("replaced")
    )
    return (
        docs.select("doc_id", F.col("text").alias("_old"), done.alias("text"), F.coalesce(F.regexp_count("text", pattern), F.lit(0)).alias("replacements"))
        .withColumn("status", status)
        .drop("_old")
    )


def change_audit(before: DataFrame, after: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """One row per key: hashes, sizes, delta, whether anything changed, size reduction in per cent, and on which side.

    A key on one side only has null for the other side's columns and counts as changed. Hashes and sizes are taken before the join, so no content is shuffled.
    Of empty content the reduction is NaN, or minus infinity where something came out.
    """
    digest = lambda df, p: df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias(f"{p}_hash"), F.octet_length(content).alias(f"{p}_size"))
    saved = F.col("input_size") - F.col("output_size")
    # of nothing: no share if nothing came out either, else without bound; the division itself would end the query
    of_nothing = F.when(saved == 0, float("nan")).when(saved < 0, float("-inf"))
    reduction = F.when(F.col("input_size") == 0, of_nothing).otherwise(saved / F.col("input_size") * 100)
    return digest(before, "input").join(digest(after, "output"), key, "full_outer").select(
        "*",
        F.when(F.col("output_hash").isNull(), "before only").when(F.col("input_hash").isNull(), "after only").otherwise("both").alias("status"),
        (F.col("output_size") - F.col("input_size")).alias("size_delta"),
        (~F.col("input_hash").eqNullSafe(F.col("output_hash"))).alias("changed"),
        F.round(reduction, 1).alias("reduction_pct"),
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(~F.col("changed")).alias("unchanged"),
        F.sum("input_size").alias("original_size"),
        F.sum("output_size").alias("compressed_size"),
    )


def verify_redaction(docs: DataFrame, terms: Terms, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, verified, leaks): terms that still occur in the document."""
    looked = with_terms(docs.select("doc_id", "text"), terms)
    leaks = F.filter("terms", lambda t: F.contains(_fold(F.col("text"), case_sensitive), _fold(t, case_sensitive)))
    return looked.select("doc_id", leaks.alias("leaks")).select("doc_id", (F.size("leaks") == 0).alias("verified"), "leaks")
