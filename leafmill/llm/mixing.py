"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import WORD, stage, whole_row

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> list[Column]:
    return [F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("s_null")]


def source_ranks(sources: DataFrame) -> DataFrame:
    """Adds `rank` (from 0) in code-point order of the source, null last, to a table with one row per source.

    The table is range-partitioned and written once; each part numbers its rows, and the parts' counts (one row per part)
    are summed up, so no task sees all sources.
    """
    order = ["s_null", "s"]
    parts = stage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("local", local).join(before, "part").withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")


def water_fill(sources: DataFrame, total: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` (double) to a table with source_size and weight: shares of `total` by weight, none above the cap.

    A source above `max_epochs` times its size is clamped there; what it leaves is dealt to the others by weight, until
    none is above. Each round is one small aggregate of three numbers; the clamped set only grows. If all are clamped,
    each has its cap. Sources of size 0 are clamped at 0.
    """
    cap = F.col("source_size") * max_epochs
    clamped, done, weight, left = F.lit(False), None, 0, total
    while True:
        row = sources.agg(
            F.sum(F.when(~clamped, F.col("weight"))).alias("w"), F.sum(F.when(clamped, cap)).alias("c"), F.count(F.when(clamped, 1)).alias("n")
        ).first()
        if row["n"] == done:
            break
        weight, left, done = int(row["w"] or 0), total - int(row["c"] or 0), row["n"]
        if not weight:
            break
        # a unit of weight now gets left / weight, which never falls from round to round; compared in exact integers
        share = F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(10,0)")
        clamped = share > cap.cast("decimal(20,0)") * F.lit(weight).cast("decimal(18,0)")
    target = F.lit(float(left)) / F.lit(float(weight or 1)) * F.col("weight")
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(target))


def mix_sources(
    docs: DataFrame,
    *,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Mixes documents so that every source's words come near its target.

    Returns one row per input row: doc_id, size, source, source_size, target, copies, taken = copies * size, and, if
    columns are to be carried, a struct `row` of them. A source that is to be read e epochs takes each of its documents floor(e) times; the
    fraction is sampled: documents in the order of a seeded hash are taken once more until the words reach the target
    (the nearest of the two sums around it). Weights repeat over the sources in code-point order, null last.

    Scale: words are counted where the text is read; only ids and sizes are shuffled. A source is cut into 4096 hash
    buckets, so a source with a third of all rows is no hot key; bucket sums give each bucket its starting sum.

    Edge cases: null or empty text has size 0 and follows the same draw (taken is 0); a null source is a source of its
    own, the last; null and repeated keys are ordinary rows (a repeated row has the same hash, ties break by size and
    are interchangeable); an empty table gives an empty result. Other input columns are ignored unless carried.
    """
    spark = docs.sparkSession
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        *source_key(F.col(source)), F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"), digest.alias("draw"),
        F.col(key).alias("doc_id"), n_words(text).alias("size"), *([whole_row(carry)] if carry else []),
    )
    by = ["s", "s_null"]
    buckets = stage(rows.groupBy(*by, "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = buckets.groupBy(*by).agg(F.sum("bucket_size").alias("source_size"))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = stage(source_ranks(sources).withColumn("weight", cycle).drop("rank"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(ranked, int(total), max_epochs).drop("weight")
    before = F.sum("bucket_size").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("bucket_size")
    starts = buckets.withColumn("before", before).drop("bucket_size").join(targets, by)
    run = Window.partitionBy(*by, "bucket").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    mixed = rows.withColumn("sum", F.sum("size").over(run) - F.col("size")).join(starts, [*by, "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.col("target") - whole * F.col("source_size")
    once_more = ((F.col("before") + F.col("sum")) * 2 + F.col("size") <= extra * 2) & (extra > 0)
    copies = whole + F.when(once_more & (F.col("source_size") > 0), 1).otherwise(0)
    named = F.when(~F.col("s_null"), F.col("s")).alias("source")
    return mixed.withColumn("copies", copies).select(
        "doc_id", "size", named, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else [])
    )
