"""Prefix trie of conversations: sorted turn sequences, common prefixes of neighbours, and range-minimum searches for the
members of every prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.blocks import prefix_sums
from leafmill.llm.common import lean, stage
from leafmill.llm.mixing import n_words

#: sequences that one sparse table covers
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: bytes of a turn in a sequence: md5 of role and text, then the number of its words
TURN, HASH = 20, 16
#: conversation ids that are joined to one string before they are hashed
IDS_AT_ONCE = 4096


# ---- range minima ----------------------------------------------------------------------------------------------------


class Minima:
    """Sparse table over an array: level k holds the minima of all runs of 2**k entries."""

    def __init__(self, values: np.ndarray):
        self.size, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.size:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def first_below(self, after: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """First index behind `after` whose value is below `limit`, or the size: a binary search by halving runs."""
        at = after + 1
        for k in reversed(range(len(self.levels))):
            fits = at + (1 << k) <= self.size
            whole = fits & (self.levels[k][np.where(fits, at, 0)] >= limit)
            at = at + (whole << k)
        return at

    def last_below(self, before: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Last index in front of `before` whose value is below `limit`, or -1."""
        at = before - 1
        for k in reversed(range(len(self.levels))):
            first = at - (1 << k) + 1
            whole = (first >= 0) & (self.levels[k][np.maximum(first, 0)] >= limit)
            at = at - (whole << k)
        return at

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minimum of [start, stop), which must not be empty."""
        k = np.frexp((stop - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for level in np.unique(k):
            of = np.flatnonzero(k == level)
            out[of] = np.minimum(self.levels[level][start[of]], self.levels[level][stop[of] - (1 << level)])
        return out


_SEARCHED = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("d", pa.int64()), ("way", pa.int32()), ("hit", pa.int64()), ("low", pa.int64())])


def _search(values: DataFrame, queries: DataFrame) -> DataFrame:
    """Answers (block, at, d, way) from the table of that block: `hit`, the next rank behind (way 1) or in front of (-1)
    `at` whose value is below d (null: none in the block), and `low`, the least `low` of the ranks that way 1 passes."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _SEARCHED.empty_table()
        rank, v, low = (rows[c].to_numpy() for c in ("rank", "v", "low"))
        order = np.argsort(rank)
        first, v, low = rank[order[0]], Minima(v[order]), Minima(low[order])
        at, d, way = (asked[c].to_numpy() for c in ("at", "d", "way"))
        at = at - first
        right, left = v.first_below(np.maximum(at, -1), d), v.last_below(np.minimum(at, v.size), d)
        found = np.where(way > 0, right < v.size, left >= 0)
        passed = (way > 0) & (right > at + 1)
        least = np.zeros(len(at), np.int64)
        least[passed] = low.least(at[passed] + 1, right[passed])
        hit = pa.array(np.where(way > 0, right, left) + first, mask=~found)
        return pa.Table.from_arrays([asked["block"], asked["at"], asked["d"], asked["way"], hit, pa.array(least, mask=~passed)], schema=_SEARCHED)

    schema = "block long, at long, d long, way int, hit long, low long"
    tables = values.withColumn("block", F.shiftright("rank", BLOCK_BITS)).groupBy("block")
    return tables.cogroup(queries.select("block", "at", "d", "way").groupBy("block")).applyInArrow(search, schema)


def _within(values: DataFrame, size: int, queries: DataFrame) -> DataFrame:
    """(at, d, way) to (at, d, way, hit, low): the search over all `size` ranks, its block first."""
    near = stage(_search(values, queries.withColumn("block", F.shiftright("at", BLOCK_BITS))))
    if size <= BLOCK:
        return near.drop("block")
    left = near.where("hit IS NULL")
    far = _beyond(values, size, left.select("block", "d", "way").distinct()).withColumnsRenamed({"hit": "far_hit", "low": "far_low"})
    met = left.join(far, ["block", "d", "way"]).select("at", "d", "way", F.col("far_hit").alias("hit"), F.least("low", "far_low").alias("low"))
    return near.where("hit IS NOT NULL").drop("block").unionByName(met)


def _beyond(values: DataFrame, size: int, queries: DataFrame) -> DataFrame:
    """(block, d, way) to (block, d, way, hit, low): the search over the ranks outside the block.

    The minima of the blocks are searched as ranks of their own, then the block that was found. A block asks one question
    per depth and way at most: the prefixes that reach over its edge.
    """
    if size <= BLOCK:
        return queries.withColumns({"hit": F.lit(None).cast("long"), "low": F.lit(None).cast("long")})
    upper = stage(values.groupBy(F.shiftright("rank", BLOCK_BITS).alias("rank")).agg(F.min("v").alias("v"), F.min("low").alias("low")))
    found = stage(_within(upper, -(-size // BLOCK), queries.select(F.col("block").alias("at"), "d", "way")))
    edge = F.when(F.col("way") > 0, F.col("block") * BLOCK - 1).otherwise((F.col("block") + 1) * BLOCK)
    inside = found.where("hit IS NOT NULL").select(F.col("hit").alias("block"), "d", "way").distinct().withColumn("at", edge)
    down = _search(values, inside).select(F.col("block").alias("in_block"), "d", "way", F.col("hit").alias("in_hit"), F.col("low").alias("in_low"))
    met = found.withColumn("in_block", F.col("hit")).join(down, ["in_block", "d", "way"], "left")
    return met.select(F.col("at").alias("block"), "d", "way", F.col("in_hit").alias("hit"), F.least("low", "in_low").alias("low"))


# ---- sequences -------------------------------------------------------------------------------------------------------


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): every turn as 40 hex digits, md5 of role and text, then the number of words, in order of turn."""
    columns = {c: F.col(f"`{c}`") for c in (conv, turn, role, text)}
    said, by = F.coalesce(columns[text], F.lit("")), F.coalesce(columns[role], F.lit(""))
    hashed = F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said))
    rows = turns.select(columns[conv].cast("long").alias("conv_id"), columns[turn].alias("turn"), hashed.alias("hash"), F.lpad(F.hex(n_words(said)), 8, "0").alias("words"))
    listed = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "hash", "words"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.concat(t["hash"], t["words"])).alias("turns"))


def with_heads(lists: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation with its first `head` (at most `most`) turns replaced by those of the conversation `base`."""
    asked = lists.withColumns({"base": base, "head": head})
    heads = lists.join(asked.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi")
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("base_turns"))
    taken = F.slice(F.coalesce("base_turns", F.array().cast("array<string>")), F.lit(1), F.col("head"))
    own = F.slice("turns", F.col("head") + 1, F.size("turns"))
    return asked.join(heads, "base", "left").select("conv_id", F.concat(taken, own).alias("turns"))


def _distinct(lists: DataFrame) -> DataFrame:
    """Sequences in order, each once: seq, conv_id (the smallest), copies, ends (hash of the ids), and an ascending `at`.

    Copies of a sequence are spread by id; runs of ids become strings, and only these strings, in order, pass the one
    running hash of a sequence.
    """
    rows = stage(lists.select(F.unhex(F.array_join("turns", "")).alias("seq"), "conv_id"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [0, *[k for k in range(1, len(seqs)) if seqs[k] != seqs[k - 1]], len(seqs)]
            cuts = [p for a, b in zip(cuts, cuts[1:]) for p in range(a, b, IDS_AT_ONCE)] + [len(seqs)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            columns = [[seqs[a] for a, _ in spans], [ids[a] for a, _ in spans], [b - a for a, b in spans], [",".join(map(str, ids[a:b])) for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["seq", "conv_id", "copies", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("seq", pa.binary()), ("conv_id", pa.int64()), ("copies", pa.int64()), ("ends", pa.string())])
        held = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held is not None and held[0] == r["seq"]:
                    held[2] += r["copies"]
                    held[3].update(b"," + r["ids"].encode())
                    continue
                if held is not None:
                    done.append(held)
                held = [r["seq"], r["conv_id"], r["copies"], hashlib.sha256(r["ids"].encode())]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*h[:3], h[3].hexdigest()))) for h in done], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*held[:3], held[3].hexdigest())))], schema=schema)

    spread = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    joined = stage(spread.mapInArrow(lean(runs), "seq binary, conv_id long, copies long, ids string"))
    whole = joined.repartitionByRange("seq").sortWithinPartitions("seq", "conv_id")
    return stage(whole.mapInArrow(lean(hashed), "seq binary, conv_id long, copies long, ends string").withColumn("at", F.monotonically_increasing_id()))


def _numbered(rows: DataFrame) -> DataFrame:
    """`at` (range number and place in it) to a dense `rank`; one small row per range passes one window."""
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    shift = parts.selectExpr("part", "sum(c) OVER (ORDER BY part) - c - first AS shift")
    return rows.join(shift, "part").withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


_NODES = pa.schema([
    ("l", pa.int64()), ("d", pa.int64()), ("words", pa.int64()), ("hit", pa.int64()), ("low", pa.int64()), ("up", pa.int64()),
    ("lcp", pa.int64()), ("copies", pa.int64()), ("leaf", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string()),
])


def _candidates(ranked: DataFrame) -> DataFrame:
    """Every distinct prefix once, at the first sequence `l` that has it, with what its own block knows.

    `hit`: first rank behind l without the prefix, `low`: least conv_id from l to there or to the end of the block, `up`:
    first rank with the prefix that is one turn shorter; null where they lie outside the block. The row of the whole
    sequence (d is its length) also has lcp (turns shared with the sequence before), copies, leaf, conv_id and ends.
    """
    # a block also sees the sequence before its first and the one behind its last
    block, place = F.shiftright("rank", BLOCK_BITS), F.col("rank") % BLOCK
    own = F.array(block)
    seen_by = F.when((place == 0) & (block > 0), F.array(block - 1, block)).when(place == BLOCK - 1, F.array(block, block + 1)).otherwise(own)
    placed = ranked.withColumn("block", F.explode(seen_by))

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        rows = rows.sort_by("rank")
        rank, conv = rows["rank"].to_numpy(), rows["conv_id"].to_numpy()
        seqs = [np.frombuffer(s, np.uint8).reshape(-1, TURN) for s in rows["seq"].to_pylist()]
        length = np.array([len(s) for s in seqs])
        lcp = np.full(len(seqs), -1)
        for i in range(1, len(seqs)):
            m = min(length[i], length[i - 1])
            differs = np.flatnonzero((seqs[i][:m] != seqs[i - 1][:m]).any(axis=1))
            lcp[i] = differs[0] if len(differs) else m
        mine = np.flatnonzero(rank >> BLOCK_BITS == number)
        if not len(mine):
            return _NODES.empty_table()
        a, b, end = mine[0], mine[-1] + 1, len(seqs)
        # the sequence behind the block ends prefixes, but is none of its members
        right, left, lows = Minima(lcp[a:end]), Minima(lcp[a:b]), Minima(conv[a:b])
        lcp, length, size = lcp[a:b], length[a:b], b - a
        next_lcp = np.append(right.levels[0], -1)[1 : size + 1]
        count = length - lcp
        i = np.repeat(np.arange(size), count)
        place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        d = lcp[i] + 1 + place
        flat = np.concatenate([np.zeros(0, np.int64), *[s[:, HASH:].copy().view(">u4").ravel().astype(np.int64) for s in seqs[a:b]], np.zeros(1, np.int64)])
        words = np.where(d > 0, flat[(np.cumsum(length) - length)[i] + d - 1], 0)
        hit = right.first_below(i, d)
        low = lows.least(i, np.minimum(hit, size))
        up, branch = i.copy(), place == 0
        up[branch] = left.last_below(i[branch], d[branch] - 1)
        first = rank[a]
        known = np.where(branch, (up >= 0) & (d > 0), True)
        up = np.where(branch & (d == 1), 0, up + first)
        last = d == length[i]
        ends = rows["ends"].combine_chunks().take(pa.array(np.where(last, i + a, 0)))
        whole = {"lcp": lcp[i], "copies": rows["copies"].to_numpy()[a:b][i], "leaf": (next_lcp < length)[i].astype(np.int64), "conv_id": conv[a:b][i]}
        columns = [pa.array(i + first), pa.array(d), pa.array(words), pa.array(hit + first, mask=hit >= end - a), pa.array(low), pa.array(up, mask=~(known | (d == 1)))]
        columns += [pa.array(c, pa.int64(), mask=~last) for c in whole.values()]
        columns.append(pa.array(np.where(last, np.array(ends.to_pylist(), object), None), pa.string()))
        return pa.Table.from_arrays(columns, schema=_NODES)

    schema = "l long, d long, words long, hit long, low long, up long, lcp long, copies long, leaf long, conv_id long, ends string"
    return placed.groupBy("block").applyInArrow(search, schema)


def prefix_trie(lists: DataFrame) -> DataFrame:
    """The trie of turn sequences. In: (conv_id, turns), one row per conversation, `turns` as `turn_lists` gives them.

    Returns one row per distinct prefix, the empty one (root) included: conv_id (smallest member), depth, parent_conv_id
    (the parent's conv_id; null for the root), n_convs (members), n_children, n_leaves (childless nodes in the subtree, the
    top included), saved_tokens (summed over the subtree: (members - 1) * words of the last turn), ends_sha256 (of the
    members' ids that end here, ascending, joined by commas).

    Distinct sequences are sorted and ranked; `lcp` is the number of turns a sequence shares with the one before. A prefix
    of depth d is a candidate at the first sequence that has it. Its right extent, and the left extent of the prefix it
    branches from, are binary searches over a sparse table of the range minima of `lcp`, each on its own. A table covers a
    block of 1024 sequences; prefixes that reach over its edge are searched in the table of the blocks' minima, round by
    round, then in the block where they end. Everything else is a difference of prefix sums over the interval found.

    Copies of a conversation are one sequence. No task sees more than a block and its two neighbours; the driver gets the
    number of sequences. One conversation is one cell (20 bytes a turn).

    Edge cases: a conversation without turns is a member of the root; an empty table gives an empty result.
    """
    nodes = stage(_candidates(stage(_numbered(_distinct(lists)))))
    found = nodes.where("lcp IS NOT NULL").select(F.col("l").alias("rank"), F.col("lcp").alias("v"), F.col("conv_id").alias("low"), "copies", "leaf", F.col("d").alias("length"), "ends")
    size = found.count()
    values = found.select("rank", "v", "low")

    # prefixes that reach beyond their block
    block = F.shiftright("l", BLOCK_BITS)
    behind = nodes.where("hit IS NULL").select(block.alias("block"), "d", F.lit(1).alias("way"))
    before = nodes.where("up IS NULL AND d > 0").select(block.alias("block"), (F.col("d") - 1).alias("d"), F.lit(-1).alias("way"))
    far = stage(_beyond(values, size, behind.union(before).distinct()))
    right = far.where("way = 1").select("block", "d", F.col("hit").alias("far_hit"), F.col("low").alias("far_low"))
    left = far.where("way = -1").select("block", (F.col("d") + 1).alias("d"), F.col("hit").alias("far_up"))
    inner = nodes.where("hit IS NOT NULL").withColumns({"far_hit": F.lit(None).cast("long"), "far_low": F.lit(None).cast("long")})
    outer = nodes.where("hit IS NULL").withColumn("block", block).join(right, ["block", "d"], "left").drop("block")
    nodes = inner.unionByName(outer)
    known = nodes.where("up IS NOT NULL OR d = 0").withColumn("far_up", F.lit(None).cast("long"))
    unknown = nodes.where("up IS NULL AND d > 0").withColumn("block", block).join(left, ["block", "d"], "left").drop("block")
    nodes = known.unionByName(unknown).select(
        "l", "d", "words", F.coalesce("hit", "far_hit", F.lit(size)).alias("hit"), F.least("low", "far_low").alias("low"), F.coalesce("up", "far_up").alias("up"))

    # members and leaves of [l, hit) are differences of prefix sums; a rank behind the last one closes them
    close = found.select("rank", "copies", "leaf").union(nodes.sparkSession.range(1).select(F.lit(size).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    sums = stage(_summed(close, {"convs": F.col("copies"), "leaves": F.col("leaf")}))
    start, stop = (sums.select(F.col("rank").alias(c), F.col("convs").alias(f"c_{c}"), F.col("leaves").alias(f"f_{c}")) for c in ("l", "hit"))
    nodes = nodes.join(start, "l").join(stop, "hit")
    nodes = stage(nodes.select("l", "d", "words", "hit", "low", "up", (F.col("c_hit") - F.col("c_l")).alias("n_convs"), (F.col("f_hit") - F.col("f_l")).alias("n_leaves")))

    # what is saved below a node: its own sequence from its depth on, and all later sequences of the interval
    saved = (F.col("n_convs") - 1) * F.col("words")
    own = nodes.withColumn("tail", F.expr("sum((n_convs - 1) * words) OVER (PARTITION BY l ORDER BY d DESC)"))
    per_rank = nodes.groupBy(F.col("l").alias("rank")).agg(F.sum(saved).alias("saved")).union(nodes.sparkSession.range(1).select(F.lit(size).cast("long"), F.lit(0).cast("long")))
    after = stage(_summed(per_rank, {"before": F.col("saved")}))
    begin, finish = after.select((F.col("rank") - 1).alias("l"), F.col("before").alias("s_l")), after.select(F.col("rank").alias("hit"), F.col("before").alias("s_hit"))
    nodes = own.join(begin, "l").join(finish, "hit").withColumn("saved_tokens", F.col("tail") + F.col("s_hit") - F.col("s_l"))
    nodes = stage(nodes.select("l", "d", "hit", "low", "up", "n_convs", "n_leaves", "saved_tokens"))

    # children; a parent meets those of every block of its interval apart, so a wide one is spread as far as it is wide
    wide = BLOCK_BITS + 6
    children = nodes.where("d > 0").select(F.col("up").alias("l"), (F.col("d") - 1).alias("d")).groupBy("l", "d").agg(F.count("*").alias("children"))
    nodes = nodes.join(children, ["l", "d"], "left").withColumn("n_children", F.coalesce("children", F.lit(0).cast("long")))
    spans = F.sequence(F.shiftright("l", wide), F.shiftright(F.col("hit") - 1, wide))
    parents = nodes.where("n_children > 0").select(F.col("l").alias("up"), F.col("d").alias("up_d"), F.col("low").alias("parent_conv_id"), F.explode(spans).alias("span"))
    nodes = nodes.withColumns({"up_d": F.col("d") - 1, "span": F.shiftright("l", wide)}).join(parents, ["up", "up_d", "span"], "left")
    ends = found.select(F.col("rank").alias("l"), F.col("length").alias("d"), "ends")
    out = nodes.join(ends, ["l", "d"], "left")
    return out.select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _summed(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Adds the sums over all lower ranks."""
    return prefix_sums(rows.withColumn("all", F.lit(0)), ["all"], ["rank"], measures, F.shiftright("rank", BLOCK_BITS + 2)).select("rank", *measures)


def conversation_trie(turns: DataFrame, *, every: int = 20, heads: int = 4) -> DataFrame:
    """`prefix_trie` of conversations that are rebuilt first: conversation c takes the first h turns of conversation
    c - c % `every` (all if it has fewer, none if it is absent), h = crc32 of c's decimal digits modulo `heads`, and goes on
    with its own turns after its first h.

    Edge cases: turns are ordered by `turn`, null first, and turns of one number by the md5 of role and text; a repeated row
    is a turn of its own; null role and text are empty; rows without conv_id belong to no conversation and take no part;
    `%` keeps the sign of c, as in SQL; other columns are ignored.
    """
    lists = stage(turn_lists(turns))
    base, head = F.col("conv_id") - F.col("conv_id") % every, F.crc32(F.col("conv_id").cast("string")) % heads
    return prefix_trie(with_heads(lists, base, head.cast("int"), heads))
