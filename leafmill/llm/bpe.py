"""Byte-level BPE encoding and decoding; huge texts by overlapping chunks stitched where pre-tokens resynchronise."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.chunks import CHUNK_CHARS, OVERLAP_CHARS, overlapping_chunks, own_part
from leafmill.llm.common import lean, pieces_of

#: before white space that follows other text: whatever stands before, a pre-token ends here, because in the pattern
#: white space only ever begins a match or fills one, and the pattern never looks back
STABLE = r"[^\s\x1c-\x1f](?=[ \n])"


@lru_cache(maxsize=2)
def load_encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ids(encoding, text: str) -> np.ndarray:
    return np.asarray(encoding.encode_ordinary(text), "<u4")


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Encodes every text by the ranks at `ranks_path`, each match of `pattern` separately, without special tokens.

    Returns one row per input row: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers). Texts of at
    most `chunk` characters are encoded whole, in Arrow batches and without a shuffle. Longer ones become overlapping
    chunks that many tasks encode; a chunk owns what lies between the first stable pre-token boundaries after its two
    cuts, where the pre-tokens of neighbours are in step, and the ids of the parts are put together in order.

    Edge cases: null and empty texts have no ids (0, empty); null and repeated keys are ordinary rows; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                ids = [_ids(encoding, t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "n_tokens", "ids"]
                )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, at = load_encoding(ranks_path, pattern), regex.compile(STABLE)
        for batch in batches:
            for r in batch.to_pylist():
                start, stop = own_part(at, r["k"], r["last"], r["piece"], r["head"], r["tail"])
                # the match before a boundary in white space may look ahead of it, so the pre-tokens end there by themselves
                ids = _ids(encoding, r["piece"][start:stop])
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "ids": ids.tobytes()}], schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("ids", pa.binary())]))

    def stitch(group: pa.Table) -> pa.Table:
        ids = b"".join(i for _, i in sorted(zip(group["k"].to_pylist(), group["ids"].to_pylist())))
        return pa.table({"row": group["row"][:1], "ids": pa.array([ids], pa.binary())})

    encoded = rows.where(length <= chunk).mapInArrow(lean(whole), f"doc_id {key_type}, n_tokens long, ids binary")
    huge = rows.where(length > chunk).withColumn("row", F.monotonically_increasing_id())
    chunks = overlapping_chunks(huge, STABLE, chunk, overlap).mapInArrow(lean(parts), "row long, k int, ids binary")
    stitched = chunks.groupBy("row").applyInArrow(stitch, "row long, ids binary")
    spliced = huge.select("row", "doc_id").join(stitched, "row").select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
    return encoded.unionByName(spliced)


def decode_bpe(encoded: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the bytes of the ids of every row, one after the other; null ids give null."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_path, pattern)
        for batch in batches:
            for part in pieces_of(batch, ids):
                texts = [None if i is None else encoding.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.select(*[f"`{f.name}`" for f in fields]).mapInArrow(lean(decode), schema)
