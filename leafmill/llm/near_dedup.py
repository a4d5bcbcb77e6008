"""MinHash near-dedup: banded candidates, filtered by odd sketches, confirmed on full shingle sets, joined to groups."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import joined, lean, mix, pieces_of, rolling, stage, word_hashes, word_spans

SHINGLE = 5
#: link at 100 * intersection >= PERCENT * union
PERCENT = 75
BANDS, ROWS = 32, 4
#: samples and bits of the coarse sketch, and of the sharp one that pairs of different components must pass
COARSE, SHARP = (BANDS * ROWS, 512), (1024, 4096)
STAR_ROUNDS = 3
#: members of a bucket that are compared in one task at once, twice over
BLOCK = 2000

_A = mix(np.arange(1, SHARP[0] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1, SHARP[0] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.uint32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORDS = [f"s{i}" for i in range(COARSE[1] // 64)]


def expected_bits(similarity: float, samples: int, bits: int) -> float:
    """Differing bits two odd sketches are expected to have: each of the 2k(1 - J) samples on one side flips a bit."""
    return bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))


def most_bits(similarity: float, samples: int, bits: int) -> int:
    """Bits in which the sketches of sets of at least this similarity differ at most, five standard deviations included."""
    flips = 2 * samples * (1 - similarity)
    here, fade = expected_bits(similarity, samples, bits), math.exp(-4 * flips / bits)
    drawn = 2 * math.sqrt(samples * similarity * (1 - similarity) * fade)  # of the samples, as it shows in the bits
    folded = math.sqrt(bits / 4 * (1 - fade) - flips * fade)  # of the places they flip
    return math.ceil(here + 5 * math.hypot(drawn, folded))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of every text, sorted; a text of fewer words has its whole sequence as one."""
    data, offsets = joined(texts, lower=True)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, offsets)
    windows = rolling(words, shingle)
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(windows[a : b - shingle + 1]))
        else:
            out.append(rolling(words[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def min_hashes(shingles: np.ndarray, samples: int) -> np.ndarray:
    """The smallest value of every hash function over a set, one function a sample."""
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[None, at : at + 2048] * _A[:samples, None] + _B[:samples, None]).min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(documents, bands) keys; the band number is part of the key."""
    parts = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * _PRIME + parts[:, :, k])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """(documents, words) of 64 bits: each sample, with its number, flips one bit."""
    count, bits = size
    numbers = np.arange(1, count + 1, dtype=np.uint64) << np.uint64(32)
    place = (mix(samples.astype(np.uint64) + numbers) % np.uint64(bits)).astype(np.int64)
    flat = place + bits * np.arange(len(samples))[:, None]
    odd = np.bincount(flat.ravel(), minlength=len(samples) * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(samples), -1)


def differing_bits(a: str, b: str) -> Column:
    """XOR population count of two sketches."""
    total = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0")))
    for w in _WORDS[1:]:
        total = total + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return total


def _describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n, node (the key of the shingle set), bands, and the words of the coarse sketch."""
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), *[(w, pa.int64()) for w in _WORDS]]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), shingle)
                samples = np.stack([min_hashes(s, COARSE[0]) for s in sets])
                bands, words = band_keys(samples), odd_sketches(samples, COARSE)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_key, sets), pa.binary()), lists]
                columns += [pa.array(words[:, k]) for k in range(len(_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.mapInArrow(lean(describe), "doc_id long, text_hash long, n long, node binary, bands array<long>, " + ", ".join(f"{w} long" for w in _WORDS))


def _full_sets(wanted: DataFrame, shingle: int) -> DataFrame:
    """(nid, shingles, sharp sketch) of the documents that stand for a set; (nid, node, text) in."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                nids, nodes, sets = part.column("nid").to_pylist(), part.column("node").to_pylist(), shingle_sets(part.column("text"), shingle)
                rows = []
                for nid, node, s in zip(nids, nodes, sets):
                    # a row may be repeated
                    if nid not in seen and set_key(s) == node:
                        seen.add(nid)
                        rows.append((nid, s.view(np.int64)))
                if rows:
                    lists = pa.array([s for _, s in rows], pa.list_(pa.int64()))
                    sharp = odd_sketches(np.stack([min_hashes(s.view(np.uint64), SHARP[0]) for _, s in rows]), SHARP)
                    columns = [pa.array([i for i, _ in rows]), lists, pa.array([w.tobytes() for w in sharp], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["nid", "shingles", "sharp"])

    return wanted.mapInArrow(lean(build), "nid long, shingles array<long>, sharp binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    # the planner takes a list for one or two elements, so it would send whole sets to all tasks through the driver
    a = sets.select(F.col("nid").alias("x"), F.col("shingles").alias("a")).hint("merge")
    b = sets.select(F.col("nid").alias("y"), F.col("shingles").alias("b")).hint("merge")
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "x").join(b, "y").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("x", "y")


def _pairs_across(members: DataFrame, percent: int) -> DataFrame:
    """(x, y) of members of a bucket in different components whose sharp sketches allow the similarity.

    One of the two is outside the bucket's main component. A pair is given by the first band key the two share, so once
    in all. Buckets are cut into blocks and each pair of blocks is compared in numpy by one task; nothing but the pairs
    that pass leaves it. Rows in: key, nid, comp, main, n, sharp, bands, size (of the bucket).
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("nid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    by = ["key", "i", "j"]
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "size")
    limit = most_bits(percent / 100, *SHARP)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if held is not None:
                    batch = pa.concat_batches([held, batch])
                keys = np.stack([batch.column(c).to_numpy() for c in by], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield batch.slice(a, b - a)
                held = batch.slice(cuts[-1])
            if held is not None and held.num_rows:
                yield held

        for group in groups():
            x, y = _compare(group, limit, percent)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    return placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(compare), "x long, y long")


def _compare(group: pa.RecordBatch, limit: int, percent: int, words_at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    nid, comp, main, own, n = (group.column(c).to_numpy() for c in ("nid", "comp", "main", "own", "n"))
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    sharp = np.frombuffer(b"".join(group.column("sharp").to_pylist()), "<u8").reshape(len(nid), -1)
    bands = group.column("bands").flatten().to_numpy().reshape(len(nid), -1)
    rest = np.flatnonzero(comp != main)
    found_x, found_y = [nid[:0]], [nid[:0]]
    step = max(1, words_at_once // sharp.size)
    for at in range(0, len(rest), step):
        r = rest[at : at + step]
        ok = comp[r][:, None] != comp[None, :]
        ok &= (comp == main)[None, :] | (nid[r][:, None] < nid[None, :])
        ok &= 100 * np.minimum(n[r][:, None], n[None, :]) >= percent * np.maximum(n[r][:, None], n[None, :])
        if i != j:
            ok &= own[r][:, None] != own[None, :]
        a, b = np.nonzero(ok)
        a = r[a]
        for k in range(0, len(a), words_at_once // sharp.shape[1]):
            p, q = a[k : k + words_at_once // sharp.shape[1]], b[k : k + words_at_once // sharp.shape[1]]
            near = np.bitwise_count(sharp[p] ^ sharp[q]).sum(axis=1, dtype=np.int64) <= limit
            p, q = p[near], q[near]
            shared = bands[p] == bands[q]
            first = bands[p, shared.argmax(axis=1)] == key
            found_x.append(nid[p[first]])
            found_y.append(nid[q[first]])
    return np.concatenate(found_x), np.concatenate(found_y)


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(nid, comp) after the linked components are joined: each takes the smallest label it reaches.

    Labels spread along the links and every step also jumps to the label's own label, so long chains close in few steps.
    Every step is written to the shared folder; only two sums reach the driver.
    """
    named = links.join(labels.withColumnsRenamed({"nid": "x", "comp": "a"}), "x").join(labels.withColumnsRenamed({"nid": "y", "comp": "b"}), "y")
    one_way = named.where("a <> b").select("a", "b").distinct()
    edges = stage(one_way.union(one_way.select("b", "a")).distinct())
    state = stage(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
    last = None
    while True:
        total = state.agg(F.sum(F.col("to").cast("decimal(38,0)")), F.count("*")).first()
        if tuple(total) == last or not total[1]:
            break
        last = tuple(total)
        near = edges.join(state.withColumnsRenamed({"a": "b", "to": "seen"}), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        spread = state.join(near, "a").select("a", F.least("to", "seen").alias("to"))
        # the label of the label is read from the state before the step: it is a valid label all the same
        jump = state.select(F.col("a").alias("to"), F.col("to").alias("further"))
        state = stage(spread.join(jump, "to", "left").select("a", F.least("to", F.coalesce("further", "to")).alias("to")))
    moved = state.select(F.col("a").alias("comp"), "to")
    return stage(labels.join(moved, "comp", "left").select("nid", F.coalesce("to", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked, directly or through others, by 100 * intersection >= `percent` * union of their sets
    of `shingle`-word shingles (A-Z lower-cased).

    Returns one row per input row: doc_id, text_hash (xxhash64 of the text), n_shingles, node (16 bytes that name the set), component_id (smallest doc_id
    of the group), group_id (a number of the group; null where there is none), kept (doc_id = component_id). Different texts
    under one doc_id can give two groups the same component_id, so only group_id tells groups apart.

    1. Every text gets 128 MinHash samples, 32 band keys of four of them, and an odd sketch of 512 bits; those that share
       a band key get a sharper one later, of 1024 samples in 4096 bits. Sample (i, value) flips one bit, so the XOR population count of two sketches estimates
       the similarity of sets that are alike. Equal sets are one node from here on, so exact copies never meet as pairs.
    2. Nodes that share a band key are candidates. Three rounds link every node to the most similar of its buckets'
       leaders (by a seeded draw, another one each round); linked nodes count as one. Then every pair in a bucket that is
       still in different components is taken: the members outside the bucket's largest component against the others.
       So all candidate pairs are linked, in one component, or compared; a bucket of n members of one group costs n
       comparisons a round, not n * n. Candidates whose sketches differ too much (five standard deviations) are passed
       over (coarse sketches in the rounds, sharp ones at the end); all others are confirmed on their full sets.
    3. Components are joined by spreading smallest labels with pointer jumping; every step is a table in the shared
       folder.

    Only sets that share no band key at all can be missed: one pair in 190 000 at a similarity of 0.75, fewer above.

    Edge cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; fewer words
    than `shingle` make one shingle of the whole sequence; a null key takes no part (component_id null, kept true);
    repeated rows share a set and so a group; different texts under one key are judged by themselves; an empty table
    gives an empty result; other columns are ignored. The key must be an integer.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    described = stage(_describe(rows, shingle))
    part = described.where("n > 0 AND doc_id IS NOT NULL")
    nodes = part.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first(w).alias(w) for w in _WORDS])
    nodes = stage(nodes.withColumns({"nid": F.monotonically_increasing_id(), "min_id": F.col("rep.doc_id")}))
    # 32 rows a node, which the planner takes for one: it would broadcast them while the nodes look small
    keyed = nodes.select("nid", F.explode("bands").alias("key")).hint("merge")
    shared = keyed.groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high")).where("low < high").select("key")
    members = stage(keyed.join(shared, "key").join(nodes.select("nid", "n", *_WORDS), "nid"))
    labels = stage(members.select("nid").distinct().withColumn("comp", F.col("nid")))
    wanted = rows.join(nodes.select("nid", "node", "rep.*").join(labels, "nid"), ["doc_id", "text_hash"]).select("nid", "node", "text")
    sets = stage(_full_sets(wanted, shingle))
    limit = most_bits(percent / 100, *COARSE)
    alike = (differing_bits("m", "o") <= limit) & (100 * F.least("m.n", "o.n") >= percent * F.greatest("m.n", "o.n"))

    for turn in range(STAR_ROUNDS):
        now = members.join(labels, "nid")
        draw = F.xxhash64("nid", F.lit(turn))
        lead = now.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "nid", "comp", "n", *_WORDS)).alias("o"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        lead = lead.where("low < high").select("key", "o.*").drop("draw")
        found = now.alias("m").join(lead.alias("o"), "key").where((F.col("m.comp") != F.col("o.comp")) & alike)
        best = found.groupBy(F.col("m.nid").alias("x")).agg(F.min(F.struct(differing_bits("m", "o").alias("bits"), F.col("o.nid").alias("y"))).alias("best"))
        links = stage(_confirm(best.select("x", F.col("best.y").alias("y")), sets, percent))
        labels = connect(labels, links)

    now = members.select("key", "nid").join(labels, "nid")
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("size")).where("comps > 1")
    now = now.join(mixed.select("key", F.col("main.comp").alias("main"), "size"), "key").join(nodes.select("nid", "n", "bands").hint("merge"), "nid").join(sets.select("nid", "sharp").hint("merge"), "nid")
    links = _confirm(stage(_pairs_across(now, percent)), sets, percent)
    labels = connect(labels, stage(links))

    placed = nodes.select("node", "nid", "min_id").join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = placed.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    groups = stage(placed.join(least, "comp").select("node", "component_id", F.col("comp").alias("group_id")))
    alone = (F.col("n") == 0) & F.col("doc_id").isNotNull()
    out = described.select("doc_id", "text_hash", "n", "node").join(groups, "node", "left")
    component = F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", component.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
