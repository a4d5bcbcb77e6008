"""Ordered per-key work that never puts a whole key into one task.

Running sums, row numbers and greedy segmentation are sequential per key, and one key may own a third of the rows.
Rows are therefore cut into bounded blocks along their order. Each block is worked on its own, only one small summary
row per block travels on, and the blocks are then finished in parallel. Sums over the blocks of a key are a window over
the summaries; greedy segments are a parallel scan that composes the blocks' step functions in rounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import stage_table

BLOCK_ROWS = 4096
#: a key owning more than one of this many shares of the rows is split
SHARES = 1024
#: keys that one frequency sketch keeps
TRACKED_KEYS = 16384

#: neighbouring blocks whose step functions are joined at once, as a power of two
FAN_BITS = 6

_BLK, _GROUP = "_blk", "_group"


def block_of(pos: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer position that is unique inside its key."""
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(rows)).cast("bigint")


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, Column],
    block: Column,
) -> DataFrame:
    """Add exclusive prefix sums per key in `order`.

    `block` must be monotone in `order` and bound the rows of one (key, block).
    """
    tagged = df.withColumn(_BLK, block)
    for name, expr in measures.items():
        tagged = tagged.withColumn(name, expr.cast("bigint"))
    totals = tagged.groupBy(*keys, _BLK).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, _BLK, *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    local = Window.partitionBy(*keys, _BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(offsets, [*keys, _BLK])
    for m in measures:
        out = out.withColumn(m, F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(local), F.lit(0)))
    return out.drop(_BLK, *[f"_o_{m}" for m in measures])


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], block: Column, name: str, start: int = 1
) -> DataFrame:
    """Dense numbering per key in `order`, without a per-key sort of all rows."""
    numbered = prefix_sums(df, keys, order, {name: F.lit(1)}, block)
    return numbered.withColumn(name, (F.col(name) + start).cast("int"))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """Add the last non-null `value` strictly before each row of its key, without a per-key sort of all rows."""
    tagged = df.withColumn(_BLK, block).withColumn("_v", value)
    ends = tagged.filter(F.col("_v").isNotNull()).groupBy(*keys, _BLK).agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    # a block looks back to the nearest earlier block that set a value
    blocks = tagged.select(*keys, _BLK).distinct().join(ends, [*keys, _BLK], "left")
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, _BLK, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    local = Window.partitionBy(*keys, _BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(carried, [*keys, _BLK])
        .withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(local), F.col("_carry")))
        .drop(_BLK, "_v", "_carry")
    )


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows holding the smallest unique `order` of their key.

    The minimum is a map-side combined aggregate, and the join back spreads a hot key by `order`.
    """
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(firsts, [*keys, order], "left_semi")


def hot_keys(rows: DataFrame, keys: list[str], shares: int = SHARES, least: int = BLOCK_ROWS) -> dict[int, int]:
    """Hash of every key with more than its share of the rows, and the number of copies its lookup rows need.

    A share is 1/`shares` of the rows, and `least` rows at least. The frequent keys come from one pass of sketches that are
    merged over tasks, so keys are not shuffled. Fewer than `shares` keys can own more than a share, which bounds what
    comes to the driver. A count that the sketch misses by a little changes the balance only, never a result.
    """
    sketch = rows.select(F.xxhash64(*keys).alias("key")).agg(
        F.expr(f"approx_top_k(key, {shares}, {TRACKED_KEYS})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    share = F.greatest(F.col("rows") / shares, F.lit(float(least)))
    found = sketch.select("rows", F.inline("top")).select("item", F.ceil(F.col("count") / share).cast("int").alias("copies"))
    return {r["item"]: r["copies"] for r in found.filter("copies > 1").collect()}


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, how: str = "inner", weigh: DataFrame | None = None,
    shares: int = SHARES, least: int = BLOCK_ROWS,
) -> DataFrame:
    """Join many rows per key with few lookup rows per key; a key is split over as many tasks as its rows need.

    Lookup rows of a frequent key (see `hot_keys`) are copied once per share of its rows, all others stay single; without
    a frequent key this is a plain join. `weigh` is a table with the same keys that is cheaper to count than `rows`.
    """
    hot = hot_keys(rows if weigh is None else weigh, keys, shares, least)
    if not hot:
        return rows.join(lookup, keys, how)
    # fewer rows than shares
    known = F.broadcast(rows.sparkSession.createDataFrame(list(hot.items()), "_key long, _copies int"))
    copies = F.coalesce("_copies", F.lit(1))
    salted = (
        rows.withColumn("_key", F.xxhash64(*keys)).join(known, "_key", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), copies).cast("int")).drop("_key", "_copies")
    )
    copied = (
        lookup.withColumn("_key", F.xxhash64(*keys)).join(known, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_key", "_copies")
    )
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def block_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], pos: str, last: str, how: str = "inner", rows_per_block: int = BLOCK_ROWS
) -> DataFrame:
    """Join rows with the one lookup row of their key, by (key, block of `pos`).

    The lookup knows the key's largest position (`last`) and is copied once per block, so an ordinary key has one copy
    and a hot key is split exactly as far as it is large. `last` is dropped.
    """
    tagged = rows.withColumn(_BLK, block_of(pos, rows_per_block))
    copies = lookup.withColumn(_BLK, F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(last, rows_per_block)))).drop(last)
    return tagged.join(copies, [*keys, _BLK], how).drop(_BLK)


# ---------------------------------------------------------------------------------------------------------------------
# Greedy segmentation
#
# A segment opens at a row and takes in rows as long as (end of row - start of segment) <= limit; the first row past the
# limit opens the next one. A `hard` row is always a segment of its own. The state between two blocks is one number, the
# start ("anchor") of the open segment, and what a block does to it is a step function with few steps.
# ---------------------------------------------------------------------------------------------------------------------

NO_ANCHOR = float("-inf")


def _hard_after(hard: np.ndarray) -> np.ndarray:
    """For each row the index of the nearest hard row at or after it (n when none)."""
    n = len(hard)
    at = np.where(hard, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


def _next_starts(a: np.ndarray, e: np.ndarray, hard: np.ndarray, limit: float) -> np.ndarray:
    far = np.searchsorted(e, a + limit, side="right")
    nxt = np.minimum(np.maximum(far, np.arange(len(a)) + 1), _hard_after(hard)[1:])
    return np.where(hard, np.arange(len(a)) + 1, nxt)


def _jumps(nxt: np.ndarray) -> list[np.ndarray]:
    """Tables of 1, 2, 4, ... steps along `nxt`; n is a place that leads to itself."""
    n = len(nxt)
    tables = [np.append(nxt, n)]
    while 1 << len(tables) <= n:
        tables.append(tables[-1][tables[-1]])
    return tables


def block_steps(a: np.ndarray, e: np.ndarray, hard: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The block as a step function: entry anchors below/at each break, and the anchor left open at its end.

    `exits[0]` holds for no open segment and for anchors below the first break; NaN means "the entry anchor stays".
    Breaks are anchors plus `limit`.
    """
    n = len(a)
    nxt = _next_starts(a, e, hard, limit)
    # the last segment start that every row leads to
    final = np.where(nxt >= n, np.arange(n), nxt)
    for _ in range(max(1, n.bit_length())):
        final = final[final]
    left = np.append(np.where(hard[final], NO_ANCHOR, a[final]), np.nan)
    reach = int(min(np.searchsorted(e, a[0] + limit, side="right"), _hard_after(hard)[0]))
    values = left[: reach + 1]
    first = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.asarray(e, dtype=float)[first - 1], values[np.append(0, first)]


def block_anchors(a: np.ndarray, e: np.ndarray, hard: np.ndarray, limit: float, entry: float) -> np.ndarray:
    """Anchor of the segment each row belongs to, given the anchor open at the block's start."""
    n = len(a)
    nxt = _next_starts(a, e, hard, limit)
    first = 0 if entry == NO_ANCHOR else int(min(np.searchsorted(e, entry + limit, side="right"), _hard_after(hard)[0]))
    starts = np.zeros(n + 1, dtype=bool)
    starts[first] = True
    for table in reversed(_jumps(nxt)):
        starts[table[np.flatnonzero(starts)]] = True
    at = np.maximum.accumulate(np.where(starts[:n], np.arange(n), -1))
    return np.where(at >= 0, np.asarray(a, dtype=float)[at], entry)


def apply_steps(breaks: np.ndarray, exits: np.ndarray, span: float, limit: float, anchor: np.ndarray) -> np.ndarray:
    """Anchors open behind a block, relative to its end, for anchors that are open in front of it."""
    value = exits[np.searchsorted(breaks, anchor + limit, side="right")]
    return np.where(np.isnan(value), anchor, value) - span


def compose_steps(first: tuple, second: tuple, limit: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Step function (breaks, exits, span) of two neighbouring blocks as one. Associative, so any neighbours may be joined
    first. Where the first block keeps the entry anchor, the breaks of the second show through."""
    (breaks, exits, span), (later_breaks, later_exits, later_span) = first, second
    total = span + later_span
    # exits are relative to the first block's start; seen from behind it they are smaller by its span
    through = apply_steps(later_breaks, later_exits, later_span, limit, np.where(np.isnan(exits), 0.0, exits) - span) + total
    if not np.isnan(exits[-1]):
        return _merged(breaks, np.where(np.isnan(exits), np.nan, through), total)
    # only the highest anchors are kept, so only the last piece is open
    low = breaks[-1] if len(breaks) else NO_ANCHOR
    shown = later_breaks + span > low
    at = np.searchsorted(later_breaks + span, low, side="right")
    inner = np.append(later_exits[at], later_exits[1:][shown]) + span
    return _merged(np.append(breaks, later_breaks[shown] + span), np.append(through[:-1], inner), total)


def _merged(breaks: np.ndarray, exits: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Neighbouring pieces that give the same are one piece."""
    same = (exits[1:] == exits[:-1]) | (np.isnan(exits[1:]) & np.isnan(exits[:-1]))
    return breaks[~same], exits[np.append(True, ~same)], span


def entry_anchors(blocks: DataFrame, keys: list[str], limit: float, fan_bits: int = FAN_BITS) -> DataFrame:
    """Anchor open at the start of every block, for keys with more than one block; a parallel scan.

    `blocks` has keys, `_blk`, and the arrays `a`, `e`, `hard` plus `span` (the coordinate length of the block); it is read
    more than once, so callers hand in a written table. Going up, the step functions of up to 64 neighbouring blocks of a
    key are composed into one, round by round, until a key has one left; going down, the anchor in front of a group passes
    through its members. No task sees more than one group of one key, however many blocks the key has.
    """

    @F.pandas_udf("struct<breaks:array<double>,exits:array<double>>")
    def steps(a: pd.Series, e: pd.Series, hard: pd.Series) -> pd.DataFrame:
        rows = [block_steps(np.asarray(x), np.asarray(y), np.asarray(h), limit) for x, y, h in zip(a, e, hard)]
        return pd.DataFrame({"breaks": [r[0] for r in rows], "exits": [r[1] for r in rows]})

    def functions(pdf: pd.DataFrame) -> list[tuple]:
        rows = pdf.sort_values(_BLK)
        return [(np.asarray(b, dtype=float), np.asarray(x, dtype=float), s) for b, x, s in zip(rows["breaks"], rows["exits"], rows["span"])]

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(lambda f, g: compose_steps(f, g, limit), functions(pdf))
        return pdf[[*keys, _GROUP]].head(1).assign(breaks=[whole[0]], exits=[whole[1]], span=[whole[2]])

    def down(members: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        anchor, entries = (float(above["entry"].iloc[0]) if len(above) else NO_ANCHOR), []
        for breaks, exits, span in functions(members):
            entries.append(anchor)
            anchor = float(apply_steps(breaks, exits, span, limit, np.float64(anchor)))
        return members.sort_values(_BLK)[[*keys, _BLK]].assign(entry=entries)

    by_key = [blocks.schema[k] for k in keys]
    entry_schema = T.StructType([*by_key, T.StructField(_BLK, T.LongType()), T.StructField("entry", T.DoubleType())])
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("breaks", "exits")]
    group_schema = T.StructType([*by_key, T.StructField(_GROUP, T.LongType()), *arrays, T.StructField("span", T.DoubleType())])
    group = F.shiftright(F.col(_BLK), fan_bits)

    several = blocks.groupBy(*keys).agg(F.max(_BLK).alias("_high"), F.min(_BLK).alias("_low")).filter("_high > _low")
    several = stage_table(several)
    highest, lowest = several.agg(F.max("_high"), F.min("_low")).first()
    if highest is None:
        return blocks.sparkSession.createDataFrame([], entry_schema)
    highest -= lowest
    summary = blocks.join(several, keys, "left_semi").select(*keys, (F.col(_BLK) - lowest).cast("bigint").alias(_BLK), F.col("span").cast("double").alias("span"), steps("a", "e", "hard").alias("s"))
    levels = [stage_table(summary.select(*keys, _BLK, "span", "s.breaks", "s.exits"))]
    while highest >> fan_bits:
        grouped = levels[-1].withColumn(_GROUP, group).groupBy(*keys, _GROUP).applyInPandas(up, group_schema)
        levels.append(stage_table(grouped.withColumnRenamed(_GROUP, _BLK)))
        highest >>= fan_bits
    # above the last round every key has one group, with nothing in front
    entries = levels[-1].select(*keys, F.lit(0).cast("bigint").alias(_GROUP)).distinct().withColumn("entry", F.lit(NO_ANCHOR))
    for level in reversed(levels):
        members = level.withColumn(_GROUP, group).groupBy(*keys, _GROUP)
        entries = members.cogroup(entries.groupBy(*keys, _GROUP)).applyInPandas(down, entry_schema)
        entries = stage_table(entries.filter(F.col(_BLK).isNotNull())).withColumnRenamed(_BLK, _GROUP)
    return entries.select(*keys, (F.col(_GROUP) + lowest).alias(_BLK), "entry")


def point_segments(points: DataFrame, keys: list[str], coord: str, limit: float, block: Column) -> DataFrame:
    """Greedy segments over point coordinates: (keys, coord, anchor), one row per distinct coordinate."""
    distinct = points.select(*keys, F.col(coord).cast("double").alias(coord), block.alias(_BLK)).distinct()
    blocks = distinct.groupBy(*keys, _BLK).agg(F.sort_array(F.collect_list(coord)).alias("a")).select(
        *keys,
        _BLK,
        "a",
        F.col("a").alias("e"),
        F.transform("a", lambda _: F.lit(False)).alias("hard"),
        F.lit(0.0).alias("span"),
    )
    blocks = stage_table(blocks)
    entries = entry_anchors(blocks, keys, limit)

    @F.pandas_udf("array<double>")
    def anchors(a: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for x, t in zip(a, entry):
            arr = np.asarray(x)
            out.append(block_anchors(arr, arr, np.zeros(len(arr), dtype=bool), limit, t))
        return pd.Series(out)

    entered = blocks.select(*keys, _BLK, "a").join(entries, [*keys, _BLK], "left")
    entry = F.coalesce(F.col("entry"), F.lit(NO_ANCHOR))
    return (
        entered.withColumn("z", F.arrays_zip(F.col("a"), anchors("a", entry).alias("anchor")))
        .select(*keys, F.explode("z").alias("z"))
        .select(*keys, F.col("z.a").alias(coord), F.col("z.anchor").alias("anchor"))
    )
