"""Merkle dataset manifest: rows are ranked per group, rolled up by the digits of their rank into nested structs, and the
nests are opened again into one proof a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stage

#: children of a node, and levels (rank digits) that are nested into one row
FAN, DIGIT_BITS, LEVELS = 16, 4, 2
BLOCK_BITS = DIGIT_BITS * LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"
_ABOVE = f"struct<path:{_PATH},subroot:string,root:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value; so no two rows give the same bytes."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank` (from 0, in `order`) and `n` (rows) within `key`.

    Rows are sorted over ranges of (key, order, id), so a hot key and even a row repeated many times spread over many
    tasks; only one small row per key and range goes through the step that is ordered per key.
    """
    tagged = stage(rows.withColumn("id", F.monotonically_increasing_id()))
    by = ["key", *order, "id"]
    placed = stage(tagged.repartitionByRange(*by).sortWithinPartitions(*by).drop("id").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    summed = runs.selectExpr(
        "key AS run_key", "part AS run_part", "sum(c) OVER (PARTITION BY key) AS n",
        "sum(c) OVER (PARTITION BY key ORDER BY part) - c - first AS shift",
    )
    same = placed["key"].eqNullSafe(summed["run_key"]) & (placed["part"] == summed["run_part"])
    return placed.join(summed, same).withColumn("rank", F.col("at") + F.col("shift")).drop("run_key", "run_part", "shift", "at", "part")


def _roll(nodes: DataFrame) -> DataFrame:
    """(key, rank, n, hash, item) to one row per 256 ranks: the digits of the rank are grouped away, the last first, and
    every group nests its children. `hash` is the root of the nest; levels above the root of a key leave it as it is."""
    rest = F.shiftright("rank", DIGIT_BITS).bitwiseAND(F.lit(FAN - 1)).cast("int")
    found = nodes.select("key", F.shiftright("rank", BLOCK_BITS).alias("block"), "n", rest.alias("d1"), F.col("rank").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("d0"), "hash", "item")
    # dealt out once by block; every grouping below keeps to it
    found = found.repartition("key", "block")
    kept, child = ["key", "block", "n"], ["item"]
    for level in range(LEVELS):
        groups = [*kept, *[f"d{k}" for k in range(level + 1, LEVELS)]]
        found = found.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{level}").alias("digit"), "hash", *child))).alias("kids"))
        joined = F.sha2(F.array_join("kids.hash", ""), 256)
        found = found.withColumn("hash", F.when(F.col("n") > FAN**level, joined).otherwise(F.col("kids")[0]["hash"]))
        child = ["kids"]
    return found


def _open(blocks: DataFrame) -> DataFrame:
    """Nested blocks with what lies above them to (key, rank, hash, item, above): every level puts the siblings before and
    after a node in front of the path that its parent has."""
    found = blocks.withColumn("rank", F.col("block"))
    for level in reversed(range(LEVELS)):
        hashes = F.col("kids.hash")

        def placed(kid: Column, i: Column) -> Column:
            before = F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before")
            after = F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("after")
            return F.struct(kid.alias("node"), F.struct(before, after).alias("step"))

        found = found.select("key", "n", "rank", "above", F.explode(F.transform("kids", placed)).alias("kid"))
        path = F.when(F.col("n") > FAN**level, F.concat(F.array("kid.step"), F.col("above.path"))).otherwise(F.col("above.path"))
        above = F.struct(path.alias("path"), F.col("above.subroot").alias("subroot"), F.col("above.root").alias("root")).alias("above")
        rank = (F.shiftleft("rank", DIGIT_BITS) + F.col("kid.node.digit")).alias("rank")
        inner = F.col("kid.node.kids").alias("kids") if level else F.col("kid.node.item").alias("item")
        found = found.select("key", "n", rank, above, F.col("kid.node.hash").alias("hash"), inner)
    return found.select("key", "rank", "hash", "item", "above")


def _tree(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The nested blocks of every round, from the leaves up, and one row (key, hash) per key; `most` rows a key at most."""
    rounds = []
    while True:
        rounds.append(stage(_roll(nodes)))
        count = F.shiftright(F.col("n") + ((1 << BLOCK_BITS) - 1), BLOCK_BITS)
        nodes = rounds[-1].select("key", F.col("block").alias("rank"), count.alias("n"), "hash", F.lit(0).alias("item"))
        most = (most + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
        if most <= 1:
            return rounds, nodes.select("key", "hash")


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Opens the rounds from the top down. (key, rank, above) of a round's blocks meet the blocks in one grouping: no join,
    and a row of at most 256 nodes on each side."""
    for blocks in reversed(rounds):
        kids, n = blocks.schema["kids"].dataType.simpleString(), "bigint"
        nests = blocks.select("key", "block", "n", "kids", F.expr(f"CAST(NULL AS {_ABOVE})").alias("above"))
        paths = above.select("key", F.col("rank").alias("block"), F.expr(f"CAST(NULL AS {n})").alias("n"), F.expr(f"CAST(NULL AS {kids})").alias("kids"), "above")
        met = nests.union(paths).groupBy("key", "block").agg(F.max("n").alias("n"), F.first("kids", ignorenulls=True).alias("kids"), F.first("above", ignorenulls=True).alias("above"))
        above = _open(met)
    return above


def merkle_proofs(docs: DataFrame, *, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """A Merkle tree over the rows of `docs`, and a proof for every row.

    A row's leaf is the sha256 of its `columns` (`field`). The leaves of a `group`, in order of `key`, are folded by
    sixteens up to a subroot, the last run with what there is; the subroots, in order of `group`, likewise up to the root.
    Returns one row per input row: doc_id, source (the group), position (in the group), leaf, subroot, root, proof (from
    the leaf up, per level the joined hashes of the siblings before and after), folded_root, verified.

    `altered` gives other values for columns of the rows `where` holds (all, if it is None), as a reader may find them
    later: folded_root is recomputed from such a leaf and the original siblings, and `verified` says whether it is the root.

    The rank of a row is split into digits to base 16. Two digits at a time are grouped away, so blocks of 256 nodes become
    one nested row each; the roots of the blocks are the nodes of the next round. Going down, a block's row is opened by
    transform and explode, and each node takes its siblings from the nest it stands in. Per round one row a block is
    shuffled; no group is ever larger than a block. Only the size of the largest group reaches the driver.

    Edge cases: null values count as `-`, unlike empty ones; a null key sorts first, a null group is a group and sorts
    first; equal keys are ordered by their leaf, and rows repeated as a whole are leaves of their own; an empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    stored = {c: F.col(f"`{c}`") for c in {*columns, key, group}}
    leaf = digest(*[field(stored[c]) for c in columns])
    found = digest(*[field((altered or {}).get(c, stored[c])) for c in columns]) if altered else F.lit(None).cast("string")
    found = F.when(where, found) if where is not None else found
    rows = docs.select(stored[group].alias("key"), stored[key].alias("doc_id"), leaf.alias("leaf"), found.alias("found"))
    ranked = stage(_ranked(rows, ["doc_id", "leaf"]))
    leaves = ranked.select("key", "rank", "n", F.col("leaf").alias("hash"), F.struct("doc_id", "found").alias("item"))
    rounds, subroots = _tree(leaves, ranked.agg(F.max("n")).first()[0] or 1)

    groups = stage(_ranked(subroots.select(F.lit(0).alias("key"), F.col("key").alias("group"), "hash"), ["group"]))
    top, roots = _tree(groups.select("key", "rank", "n", "hash", F.struct("group").alias("item")), groups.count())
    empty = F.expr(f"CAST(array() AS {_PATH})")
    whole = roots.select("key", F.lit(0).cast("bigint").alias("rank"), F.struct(empty.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("above"))
    opened = _descend(top, whole)
    below = F.struct(F.col("above.path").alias("path"), F.col("hash").alias("subroot"), F.col("above.root").alias("root")).alias("above")
    proofs = _descend(rounds, opened.select(F.col("item.group").alias("key"), F.lit(0).cast("bigint").alias("rank"), below))

    fold = F.aggregate("above.path", F.coalesce("item.found", "hash"), lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))
    out = proofs.select(
        F.col("item.doc_id").alias("doc_id"), F.col("key").alias("source"), F.col("rank").alias("position"), F.col("hash").alias("leaf"),
        F.col("above.subroot").alias("subroot"), F.col("above.root").alias("root"), F.col("above.path").alias("proof"), fold.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: str | Column) -> Column:
    """sha256 of the siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)
