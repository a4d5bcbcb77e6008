"""N-gram Jaccard join: parity sketches of token sets, a pigeonhole join of their parts per size band, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import lean, mix, pieces_of, power_of_two, run_starts, stage
from leafmill.llm.near_dedup import connect, set_key, shingle_sets

SHINGLE = 3
#: link at 100 * intersection >= PERCENT * union
PERCENT = 90
#: largest set of a size band, as a multiple of its smallest one
BAND = 1.25
STAR_ROUNDS = 3
#: members of a bucket that are compared in one task at once, with as many others
BLOCK = 1000
#: a bucket that costs more comparisons is divided by the parts of another sketch, at most so many times
COMPARED, DIVISIONS = BLOCK * BLOCK, 3
#: partners a member gives of a pair of blocks, round by round, before all are given
NEAREST = (1, 1, 4)
#: bits of a stored sketch per token, and at most
SKETCH, MOST_BITS = 4, 1 << 17

_SALT = np.uint64(0xD1B54A32D192ED03)
_BAND_BITS = np.uint64(7)


def most_different(a, b, percent: int):
    """Largest symmetric difference of linked sets of `a` and `b` tokens."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest set, and number of sketch parts, of every size band up to sets of `most` tokens.

    The parts are one more than linked sets can differ in tokens if the smaller is of this band, so they agree in a part.
    """
    low, high, ratio = [1], [1], max(BAND, 100 / percent)
    while high[-1] < most:
        low.append(high[-1] + 1)
        high.append(max(low[-1], int(low[-1] * ratio)))
    low, high = np.array(low), np.array(high)
    return low, high, most_different(high, 100 * high // percent, percent) + 1


def sketch_parts(tokens: np.ndarray, parts: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """One number per part of the parity sketch, and whether the part has tokens.

    A token has its place, one bit among 2**64, in the part that its high bits choose. Bits that are hit twice cancel; the
    number is the XOR of the places whose bit is set, so sets whose parts are alike agree, whatever was cancelled.
    """
    place = tokens if not turn else np.sort(mix(tokens ^ mix(np.array([turn], np.uint64) * _SALT)))
    part = ((place >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(run_starts(part))
    out, filled = np.zeros(parts, np.uint64), np.zeros(parts, bool)
    at = part[first].astype(np.int64)
    out[at], filled[at] = np.bitwise_xor.reduceat(place, first), True
    return out, filled


def part_keys(tokens: np.ndarray, band: int, parts: int, bucket: int = 0, turn: int = 0, divide: bool = False) -> np.ndarray:
    """Join keys of a set in a band: one per part; the last bits are the band. With `divide` the key of an empty part, which
    says little, is divided by the parts of the next sketch, in which linked sets agree somewhere as well."""
    found, filled = sketch_parts(tokens, parts, turn)
    base = mix(np.array([bucket, turn + 1], np.uint64) * _SALT)
    number = np.arange(1, parts + 1, dtype=np.uint64) + np.uint64(band << 32)
    keys = mix(found + mix(number * _SALT + base[:1] + base[1:]))
    out = [keys[filled]]
    if divide and turn < DIVISIONS:
        out += [part_keys(tokens, band, parts, int(k), turn + 1, True) for k in keys[~filled]]
    else:
        out.append(keys[~filled])
    return np.concatenate(out) >> _BAND_BITS << _BAND_BITS | np.uint64(band)


def set_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set in its own band and, if smaller partners may be in the band below, in that one. Bands whose sets link
    with equal ones only give none: equal sets are one node."""
    n = len(tokens)
    low, high, parts = bands(percent, power_of_two(n, 1024))
    own = int(np.searchsorted(low, n, side="right")) - 1
    smallest = -(-n * percent // 100)
    here = [b for b in (own - 1, own) if b >= 0 and high[b] >= smallest and parts[b] > 1]
    # where parts have many tokens, empty ones are rare; both partners decide by the band alone
    found = [part_keys(tokens, b, int(parts[b]), divide=bool(low[b] >= 5 * parts[b])) for b in here]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Every token flips one of the bits; more bits for larger sets. Half as many are the XOR of the halves."""
    bits = min(power_of_two(SKETCH * len(tokens), 512), MOST_BITS)
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def stacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches folded to the size of the smallest, as rows of 64-bit words."""
    size = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, "<u8").reshape(-1, size), axis=0) for s in sketches])


def _describe(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, node (the key of the token set), keys."""
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64()))]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), shingle)
                keys = pa.array([set_keys(s, percent).view(np.int64) for s in sets], pa.list_(pa.int64()))
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_key, sets), pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.mapInArrow(lean(describe), "doc_id long, text_hash long, n long, node binary, keys array<long>")


def _full_sets(wanted: DataFrame, shingle: int) -> DataFrame:
    """(nid, n, tokens, sketch) of the texts that stand for a set; (nid, text) in."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                rows = []
                for nid, tokens in zip(part.column("nid").to_pylist(), shingle_sets(part.column("text"), shingle)):
                    if nid not in seen:  # a row may be repeated
                        seen.add(nid)
                        rows.append((nid, tokens))
                columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64())]
                columns += [pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64())), pa.array([parity_sketch(s) for _, s in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["nid", "n", "tokens", "sketch"])

    return wanted.mapInArrow(lean(build), "nid long, n long, tokens array<long>, sketch binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    a, b = sets.select(F.col("nid").alias("x"), F.col("tokens").alias("a")), sets.select(F.col("nid").alias("y"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "x").join(b, "y").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("x", "y")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, nid, comp, main, size, rest) of the buckets that still hold several components; `main` is the
    largest of the bucket, `rest` the number of members outside it."""
    now = members.join(labels, "nid")
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("size")).where("comps > 1")
    return now.join(mixed.select("key", F.col("top.comp").alias("main"), "size", (F.col("size") - F.col("top.c")).alias("rest")), "key")


def _divided(crowded: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Members of crowded buckets, dealt to smaller ones by the parts of a sketch not used before; (key, nid) in and out."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nid, key, tokens in zip(*(batch.column(c) for c in ("nid", "key", "tokens"))):
                tokens = tokens.values.to_numpy().view(np.uint64)
                band = key.as_py() & ((1 << int(_BAND_BITS)) - 1)
                parts = int(bands(percent, power_of_two(2 * len(tokens), 1024))[2][band])
                keys = part_keys(tokens, band, parts, key.as_py() & 0xFFFFFFFFFFFFFFFF, DIVISIONS + turn).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), nid.as_py()))], ["key", "nid"])

    return crowded.select("key", "nid").join(sets.select("nid", "tokens"), "nid").mapInArrow(lean(divide), "key long, nid long")


def _pairs_across(mixed: DataFrame, sets: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """(x, y, key) of members of a bucket in different components whose sketches allow a link; x is outside the main one.

    The members are cut into blocks, those outside the main component are cut into blocks once more, and each pair of
    blocks is compared in numpy by one task. With `best` a member gives only its so many nearest partners of a pair of
    blocks, and a pair of blocks that has more says so by its key (null where all are given).
    """
    outside = F.col("comp") != F.col("main")
    blocks, sides = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("size", "rest"))
    own, side = F.pmod(F.xxhash64("nid"), blocks).cast("int"), F.pmod(F.xxhash64("nid", F.lit(1)), sides).cast("int")
    every, by = F.sequence(F.lit(0), sides - 1), ["key", "i", "j"]
    rows = mixed.join(sets.select("nid", "n", "sketch"), "nid").withColumns({"blocks": blocks, "own": own, "side": side})
    held = rows.withColumn("i", F.col("own")).withColumn("j", F.explode(every)).withColumn("asks", F.lit(False))
    asking = rows.where(outside).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.col("side")).withColumn("asks", F.lit(True))
    columns = [*by, "nid", "comp", "main", "n", "sketch", "asks"]
    placed = held.select(*columns).union(asking.select(*columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.RecordBatch]:
            waiting = None
            for batch in batches:
                if waiting is not None:
                    batch = pa.concat_batches([waiting, batch])
                keys = np.stack([batch.column(c).to_numpy() for c in by], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield batch.slice(a, b - a)
                waiting = batch.slice(cuts[-1])
            if waiting is not None and waiting.num_rows:
                yield waiting

        for group in groups():
            x, y, more = _compare(group, percent, best)
            if len(x):
                key = pa.array(np.full(len(x), group.column("key")[0].as_py()), mask=np.full(len(x), not more))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), key], ["x", "y", "key"])

    return placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(compare), "x long, y long, key long")


def _compare(group: pa.RecordBatch, percent: int, best: int | None, words_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs whose sketches differ in no more bits than linked sets of their sizes differ in tokens, and whether there are
    more than the `best` ones of each member that are given."""
    nid, comp, main, n = (group.column(c).to_numpy() for c in ("nid", "comp", "main", "n"))
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    sketch = stacked(group.column("sketch").to_pylist())
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    found_x, found_y, more = [nid[:0]], [nid[:0]], False
    step = max(1, words_at_once // max(1, len(right)))
    for at in range(0, len(left), step):
        a = left[at : at + step]
        ok = comp[a][:, None] != comp[right][None, :]
        ok &= (comp[right] == main[right])[None, :] | (nid[a][:, None] < nid[right][None, :])
        ok &= 100 * np.minimum(n[a][:, None], n[right][None, :]) >= percent * np.maximum(n[a][:, None], n[right][None, :])
        p, q = np.nonzero(ok)
        p, q = a[p], right[q]
        size = max(1, words_at_once // sketch.shape[1])
        bits = [np.bitwise_count(sketch[p[k : k + size]] ^ sketch[q[k : k + size]]).sum(axis=1, dtype=np.int64) for k in range(0, len(p), size)]
        spare = most_different(n[p], n[q], percent) - np.concatenate([np.empty(0, np.int64), *bits])
        p, q, spare = p[spare >= 0], q[spare >= 0], spare[spare >= 0]
        if best is not None:
            order = np.lexsort((nid[q], -spare, p))
            p, q = p[order], q[order]
            first = np.flatnonzero(run_starts(p))
            near = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p)))) < best
            more |= not near.all()
            p, q = p[near], q[near]
        found_x.append(nid[p])
        found_y.append(nid[q])
    return np.concatenate(found_x), np.concatenate(found_y), more


def _linked(mixed: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`labels` after all links between components in the given buckets are joined.

    A near group of m members has m * m pairs, but few links join it. So members give their nearest partners first, these
    are confirmed and joined, and only buckets that have more are looked at again, with the labels of then. What is still
    apart after `NEAREST` is compared whole, so no pair is left out.
    """
    for best in (*NEAREST, None):
        found = stage(_pairs_across(mixed, sets, percent, best))
        labels = connect(labels, stage(_confirm(found.select("x", "y").distinct(), sets, percent)))
        again = found.where("key IS NOT NULL").select("key").distinct()
        if best is None or again.isEmpty():
            return labels
        mixed = stage(_mixed(mixed.select("key", "nid").join(again, "key"), labels))
    return labels


def jaccard_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked, directly or through others, by 100 * intersection >= `percent` * union of their sets
    of `shingle`-word shingles (A-Z lower-cased).

    Returns one row per input row: doc_id, text_hash, n_shingles, component_id (smallest doc_id of the group), group_id (a
    number of the group, null where there is none). Copies and near copies are not listed as pairs: every link between
    different texts counts towards its group, and most are implied by it.

    1. Every set is one node, so copies never meet. A parity sketch gives each token one bit, flipped by every token that
       falls on it; two sketches differ in at most as many bits as the sets in tokens. Sets of a size band that link
       differ in at most d tokens, so of d + 1 parts of their sketches at least one is the same: the parts are the join
       keys. Sets also take the keys of the band below if a partner may be in it. No link is missed by this.
    2. Nodes that share a key are candidates. Three rounds link every node to that of its buckets' leaders (by a seeded
       draw) with which it shares most parts. Then the members of a bucket outside its largest component are compared with
       the others, in blocks; a bucket that would cost over 1 000 000 comparisons is first divided by the parts of another
       sketch (linked sets agree there as well), up to three times. Pairs whose whole sketches differ in more bits than the
       sizes allow are passed over; the others are confirmed on their full sets. The nearest partners are confirmed and
       joined first: pairs that they bring into one component are implied and not listed; all others are.
    3. Components are joined by spreading smallest labels; every step is a table in the shared folder.

    Tokens are 64-bit hashes of the shingles. Edge cases: null and empty texts, and texts without words, have an empty set
    and are linked with nothing (component_id is their own doc_id); fewer words than `shingle` make one shingle of the whole
    sequence; a null key takes no part (component_id null); repeated rows share a set and so a group; different texts under
    one key are judged by themselves; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    described = stage(_describe(rows, shingle, percent))
    part = described.where("n > 0 AND doc_id IS NOT NULL")
    nodes = part.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("keys").alias("keys"))
    nodes = stage(nodes.withColumn("nid", F.monotonically_increasing_id()))
    keyed = nodes.select("nid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high")).where("low < high").select("key")
    members = stage(keyed.join(shared, "key"))
    labels = stage(members.select("nid").distinct().withColumn("comp", F.col("nid")))
    sets = stage(_full_sets(rows.join(nodes.select("nid", "rep.*").join(labels, "nid"), ["doc_id", "text_hash"]).select("nid", "text"), shingle))

    for turn in range(STAR_ROUNDS):
        now = members.join(labels, "nid")
        lead = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("nid", F.lit(turn)).alias("draw"), "nid", "comp")).alias("o"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        lead = lead.where("low < high").select("key", F.col("o.nid").alias("y"), F.col("o.comp").alias("other"))
        found = now.join(lead, "key").where("comp <> other").groupBy(F.col("nid").alias("x"), "y").agg(F.count("*").alias("parts"))
        best = found.groupBy("x").agg(F.max(F.struct("parts", "y")).alias("best"))
        labels = connect(labels, stage(_confirm(best.select("x", "best.y"), sets, percent)))

    dear = F.col("rest") * F.col("size") > COMPARED
    for turn in range(1, DIVISIONS + 1):
        mixed = stage(_mixed(members, labels))
        crowded = mixed.where(dear)
        if turn == DIVISIONS or crowded.isEmpty():
            pairs = mixed
            members = None
        else:
            pairs, members = mixed.where(~dear), stage(_divided(crowded, sets, percent, turn))
        labels = _linked(pairs, labels, sets, percent)
        if members is None:
            break

    placed = nodes.select("node", "nid", F.col("rep.doc_id").alias("min_id")).join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = placed.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    groups = stage(placed.join(least, "comp").select("node", "component_id", F.col("comp").alias("group_id")))
    out = described.select("doc_id", "text_hash", "n", "node").join(groups, "node", "left")
    known, grouped = F.col("doc_id").isNotNull(), F.col("n") > 0
    component = F.when(known & grouped, F.col("component_id")).when(known, F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(known, F.col("group_id")).alias("group_id"))
