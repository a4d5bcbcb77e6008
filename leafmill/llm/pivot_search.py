"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import lean, stage

#: at most so many vectors, the first by a seeded hash of their ids, are pivots
PIVOTS = 64
#: vectors of one annulus, and queries of one chunk
ANNULUS, CHUNK = 1024, 256
#: annuli each chunk looks at first, and annuli one task visits for one chunk
SEEDS, VISITS = 2, 256


def _narrow(values: np.ndarray) -> tuple[str, bytes]:
    """Integers in the smallest type that holds them all."""
    least = int(np.abs(values).max()) if values.size else 0
    kind = next((k for k, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if least <= top), "<i8")
    return kind, values.astype(kind).tobytes()


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where those are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class _Pivots:
    """Distances in the space where the inner product decides: every vector gets one more component, which brings all to
    the length of the longest; a query gets 0 there. Then |q - v|**2 = |q|**2 + longest - 2 * <q, v>."""

    def __init__(self, vectors: np.ndarray, longest: int):
        self.vectors, self.longest = vectors.astype(np.float64), float(longest)
        self.lift = self._lift(self.vectors)
        #: rounding of the distances, many times over
        self.slack = 1e-6 * (1 + math.sqrt(self.longest))

    def _lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (v * v).sum(axis=1), 0))

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        same = v @ self.vectors.T + self._lift(v)[:, None] * self.lift[None, :]
        return np.sqrt(np.maximum(2 * self.longest - 2 * same, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.longest - 2 * (q @ self.vectors.T), 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a vector has the given score; unbounded where no score is known."""
        q = q.astype(np.float64)
        far = np.sqrt(np.maximum((q * q).sum(axis=1) + self.longest - 2 * np.where(np.isfinite(score), score, 0), 0)) + self.slack
        return np.where(np.isfinite(score), far, np.inf)


def _packed(rows: DataFrame, pivots: _Pivots, size: int, *, queries: bool) -> DataFrame:
    """Rows (id, v) to blocks of at most `size` of one nearest pivot, neighbours by distance to it: the annuli."""
    fields = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                distance = pivots.of_queries(v) if queries else pivots.of_vectors(v)
                nearest = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(v)), nearest])], ["id", "v", "pivot", "distance"]
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def block(rows: pa.RecordBatch) -> dict:
            kind, data = _narrow(rows.column("v").flatten().to_numpy())
            d = rows.column("distance").to_numpy()
            return {"pivot": rows.column("pivot")[0].as_py(), "low": d.min(), "high": d.max(), "ids": rows.column("id").to_numpy().astype("<i8").tobytes(), "kind": kind, "data": data}

        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            pivot = rows.column("pivot").to_numpy()
            cuts = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                stop = b if b < len(pivot) else b - (b - a) % size
                done += [block(rows.slice(k, min(size, stop - k))) for k in range(a, stop, size)]
                held = rows.slice(stop)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=fields)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([block(held)], schema=fields)

    order = ["pivot", "distance", "id"]
    placed = rows.mapInArrow(lean(place), "id long, v array<long>, pivot int, distance double")
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(pack), "pivot int, low double, high double, ids binary, kind string, data binary")
    return stage(blocks.withColumn("block", F.monotonically_increasing_id()))


class _Best:
    """The k best of every query of a chunk so far, by score, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, known: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.known = known  # a score that k others are known to reach; -inf if none is
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def visit(self, ids: np.ndarray, vectors: np.ndarray, which: np.ndarray) -> None:
        scores = _scores(self.vectors[which], vectors)
        for row, i in zip(scores, which.tolist()):
            good = np.flatnonzero((row >= self.known[i]) & (ids != self.ids[i]))
            if not len(good):
                continue
            s, v = np.concatenate([self.found[i][0], row[good]]), np.concatenate([self.found[i][1], ids[good]])
            top = np.lexsort((v, -s))[: self.k]
            self.found[i] = s[top], v[top]
            if len(top) == self.k:
                self.known[i] = max(self.known[i], s[top[-1]])

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.found]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([v for _, v in self.found])), pa.array(np.concatenate([s for s, _ in self.found]))], ["query_id", "vec_id", "score"]
        )


def _search(pairs: DataFrame, pivots: _Pivots, k: int) -> DataFrame:
    """Visits the annuli of each (chunk, part) in the order of `gap`; passes an annulus over for every query whose k-th
    score it cannot reach by the triangle inequality."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, to_pivots = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("chunk", "part", "pivot", "low", "high")}
                if (r["chunk"], r["part"]) != now:
                    if best:
                        yield best.rows()
                    now = r["chunk"], r["part"]
                    ids = np.frombuffer(batch.column("q_ids")[i].as_py(), "<i8")
                    vectors = np.frombuffer(batch.column("q_data")[i].as_py(), batch.column("q_kind")[i].as_py()).reshape(len(ids), -1)
                    known = np.frombuffer(batch.column("known")[i].as_py(), "<f8").copy() if batch.column("known")[i].is_valid else np.full(len(ids), -np.inf)
                    best, to_pivots = _Best(ids, vectors, known, k), pivots.of_queries(vectors)
                d = to_pivots[:, r["pivot"]]
                gap = np.maximum(np.maximum(r["low"] - d, d - r["high"]), 0)
                which = np.flatnonzero(gap <= pivots.reach(best.vectors, best.known) + pivots.slack)
                if len(which):
                    v_ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                    best.visit(v_ids, np.frombuffer(batch.column("data")[i].as_py(), batch.column("kind")[i].as_py()).reshape(len(v_ids), -1), which)
        if best:
            yield best.rows()

    columns = ["chunk", "part", "gap", "pivot", "low", "high", "ids", "kind", "data", "q_ids", "q_kind", "q_data", "known"]
    return pairs.select(*columns).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "gap").mapInArrow(lean(search), "query_id long, vec_id long, score long")


def _first_k(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """The k rows with the largest integer inner product for every query row: query_id, rank, vec_id, score.

    Components become floor(scale * x), x as double. Candidates are all rows but the query's own; ties go to smaller ids.

    1. Every vector is keyed by its nearest pivot and its distance to it, range-partitioned in that order, and packed to
       annuli of 1024 vectors; however many vectors one pivot attracts, they are spread.
    2. Queries are packed to chunks of 256 the same way. A chunk first visits the two annuli of its own pivot that lie
       nearest, which gives every query a k-th score.
    3. A vector that reaches that score lies within a known distance, so by the triangle inequality only annuli that
       overlap [distance to pivot - reach, distance to pivot + reach] are joined to the chunk. Tasks visit them from the
       nearest outwards, up to 256 for one chunk, raise the k-th scores as they go and pass over what cannot reach them.

    The result is exact whatever the pivots are; they are at most `n_pivots` vectors, a bounded sample of the table.

    Edge cases: rows with a null id, a null or empty vector, or a null or non-finite component take no part, nor do
    vectors of another length than the most frequent (the longest of those, on a tie); rows with the query's id are its
    own row; repeated candidates count as often as they occur; fewer candidates than k are all given; an empty table
    gives an empty result; other columns are ignored. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine & (F.size(vector) > 0))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = usable.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = stage(rows.where(F.size("v") == length["n"]))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    longest = rows.agg(F.max(square)).first()[0]
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()
    pivots = _Pivots(np.array([r["v"] for r in picked], np.int64), longest)

    index = _packed(rows.select("id", "v"), pivots, ANNULUS, queries=False)
    asked = _packed(rows.where("asks").select("id", "v"), pivots, CHUNK, queries=True)
    asked = asked.withColumnsRenamed({"block": "chunk", "ids": "q_ids", "kind": "q_kind", "data": "q_data", "pivot": "q_pivot", "low": "q_low", "high": "q_high"})
    annuli = index.select("block", "pivot", "low", "high")
    # the annuli nearest to a chunk, of its own pivot
    apart = F.greatest(F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"), F.lit(0.0))
    near = asked.select("chunk", "q_pivot", "q_low", "q_high").join(annuli, F.col("pivot") == F.col("q_pivot")).withColumn("gap", apart)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("chunk").orderBy("gap", "block"))).where(F.col("n") <= SEEDS).select("chunk", "block", "gap")
    asked_once = asked.select("chunk", "q_ids", "q_kind", "q_data")
    seeds = near.join(asked_once, "chunk").join(index, "block").withColumns({"part": F.lit(0).cast("long"), "known": F.lit(None).cast("binary")})
    seeded = _first_k(_search(seeds, pivots, k), k)
    kth = stage(seeded.where(F.col("rank") == k).select("query_id", "score"))

    reached = stage(_reached(asked_once, kth, pivots))
    wide = reached.select("chunk", F.posexplode("from").alias("pivot", "from"), "to").withColumn("to", F.element_at("to", F.col("pivot") + 1))
    wanted = wide.join(annuli, "pivot").where((F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from")))
    gap = F.greatest(F.col("low") - F.col("to"), F.col("from") - F.col("high"), F.abs((F.col("low") + F.col("high") - F.col("from") - F.col("to")) / 2))
    parts = F.ceil(F.lit(index.count()) / VISITS).cast("long")
    wanted = wanted.select("chunk", "block", gap.alias("gap"), F.pmod(F.xxhash64("block"), parts).alias("part"))
    pairs = wanted.join(asked_once, "chunk").join(reached.select("chunk", "known"), "chunk").join(index, "block")
    return _first_k(_search(pairs, pivots, k), k).select("query_id", "rank", "vec_id", "score")


def _reached(asked: DataFrame, kth: DataFrame, pivots: _Pivots) -> DataFrame:
    """Of every chunk: the k-th scores known (doubles, -inf if none), and per pivot the least and the largest distance
    that a vector reaching the k-th score of one of its queries can have."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("q_ids").to_pylist()):
                q = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), chunk)), pa.array(np.arange(len(q)), pa.int32()), pa.array(q)], ["chunk", "place", "query_id"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["q_data"], r["q_kind"]).reshape(len(r["q_ids"]) // 8, -1)
                known = np.full(len(q), -np.inf)
                for s in r["scores"] or []:
                    known[s["place"]] = s["score"]
                d, far = pivots.of_queries(q), pivots.reach(q, known)[:, None] + pivots.slack
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": r["chunk"], "known": known.astype("<f8").tobytes(), "from": (d - far).min(axis=0).tolist(), "to": (d + far).max(axis=0).tolist()}],
                    schema=pa.schema([("chunk", pa.int64()), ("known", pa.binary()), ("from", pa.list_(pa.float64())), ("to", pa.list_(pa.float64()))]),
                )

    places = asked.select("chunk", "q_ids").mapInArrow(lean(unpack), "chunk long, place int, query_id long")
    # a chunk has at most CHUNK queries, so its list is bounded
    scores = places.join(kth, "query_id").groupBy("chunk").agg(F.collect_list(F.struct("place", "score")).alias("scores"))
    return asked.join(scores, "chunk", "left").mapInArrow(lean(bound), "chunk long, known binary, from array<double>, to array<double>")
