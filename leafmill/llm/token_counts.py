"""Token counts of documents, huge ones by overlapping chunks spliced at proven stable boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.chunks import CHUNK_CHARS, OVERLAP_CHARS, overlapping_chunks, own_part
from leafmill.llm.common import lean, pieces_of, stage, text_bytes

#: before a space that follows neither a space nor the escaped space: no piece of such a vocabulary crosses this place
STABLE = "[^ ▁](?= )"


@lru_cache(maxsize=2)
def load_model(path: str):
    """The processor of `path`, checked for what the splice rests on: no piece has a word start behind other text, and
    the normaliser leaves the text as it is but for one space put in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if regex.search("[^▁]▁", p)]
    if crossing or model.encode_as_pieces("a  b") != model.encode_as_pieces("a") + ["▁", *model.encode_as_pieces("b")]:
        raise ValueError(f"texts can't be spliced for {path}")
    return model


def count_tokens(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Tokens of every text as the sentencepiece model at `model_path` gives them, without begin or end tokens.

    Returns one row per input row: doc_id, n_bytes (UTF-8), n_tokens. Texts of at most `chunk` characters are encoded
    whole, in Arrow batches and without a shuffle. Longer ones become overlapping chunks that many tasks encode with
    offsets; each chunk counts the tokens between the first stable boundaries after its two cuts. Where an overlap holds
    no boundary it is widened until one is found, at last to the end of the text. If a boundary is no token start in the
    chunk's own encoding, the alignment has failed: then the overlap is the whole text, which is encoded at once.

    Edge cases: null and empty texts have 0 bytes and 0 tokens; null and repeated keys are ordinary rows; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                ids = model.encode([t or "" for t in part.column("text").to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(map(len, ids), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = load_model(model_path), regex.compile(STABLE)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start, stop = own_part(at, r["k"], r["last"], r["piece"], r["head"], r["tail"])
                n = tokens_between(model, r["piece"], start, stop)
                out.append({"row": r["row"], "n_tokens": n, "failed": n is None})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("failed", pa.bool_())]))

    key_type = rows.schema["doc_id"].dataType.simpleString()
    small = rows.where(length <= chunk).withColumn("n_bytes", text_bytes("text"))
    counts = f"doc_id {key_type}, n_bytes long, n_tokens long"
    counted = small.mapInArrow(lean(whole), counts)
    huge = rows.where(length > chunk).withColumn("row", F.monotonically_increasing_id())
    encoded = overlapping_chunks(huge, STABLE, chunk, overlap).mapInArrow(lean(parts), "row long, n_tokens long, failed boolean")
    sums = stage(encoded.groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"), F.max("failed").alias("failed")))
    sized = huge.select("row", "doc_id", "text", text_bytes("text").alias("n_bytes"))
    spliced = sized.drop("text").join(sums.where("NOT failed"), "row").select("doc_id", "n_bytes", "n_tokens")
    again = sized.join(sums.where("failed").select("row"), "row").select("doc_id", "text", "n_bytes").mapInArrow(lean(whole), counts)
    return counted.unionByName(spliced).unionByName(again)


def tokens_between(model, piece: str, start: int, stop: int) -> int | None:
    """Tokens of `piece` that begin in [start, stop); None if one of the two is neither a token start nor an end of it."""
    found = model.encode(piece, return_type="proto").pieces
    begins = np.fromiter((p.begin for p in found), np.int64, len(found))
    end = len(piece.encode())
    start, stop = len(piece[:start].encode()), len(piece[:stop].encode())  # offsets count bytes
    for place in (start, stop):
        if 0 < place < end and place not in begins:
            return None
    return int(((begins >= start) & ((begins < stop) | (stop == end))).sum())
