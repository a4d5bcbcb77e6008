"""Overlapping chunks of huge texts, cut so that each can be encoded on its own and the parts splice exactly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import lean

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256


def resync(boundary: regex.Pattern, text: str, start: int, stop: int) -> int:
    """First stable boundary of `text` in [start, stop), or -1. `boundary` looks at the characters around a position
    only, so every chunk that sees them finds the same place."""
    found = boundary.search(text, max(start - 1, 0), stop)
    return found.end() if found else -1


def overlapping_chunks(huge: DataFrame, boundary: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(row, text) to (row, k, last, piece, head, tail): `piece` is chunk k with an overlap on both sides.

    `head` and `tail` are the nominal cuts inside the piece (before the left overlap ends, after the chunk). Where no
    stable boundary lies in the overlap after a cut, that overlap is widened (doubled, looking at new text only) until one
    does or the text ends. A stretch without boundaries belongs to the chunk it begins in as a whole: the next chunk starts
    just before the boundary that ends it. So a text is looked at once, and its pieces are together little longer than it.
    The rows are dealt out anew, so one huge text is encoded by many tasks.
    """
    schema = "row long, k int, last boolean, piece string, head int, tail int"
    fields = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("piece", pa.string()), ("head", pa.int32()), ("tail", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = regex.compile(boundary)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                n, start, k, last = len(text), 0, 0, False
                while not last:
                    stop = min(start + chunk, n)
                    seen, right, found = stop, min(stop + overlap, n), -1
                    while stop < n:
                        found = resync(at, text, seen, right)
                        if found >= 0 or right == n:
                            break
                        seen, right = right, min(stop + 2 * (right - stop), n)
                    last = found < 0
                    left, right = max(start - 1, 0), n if last else min(max(found + 2, stop + overlap), n)
                    piece = {"row": row, "k": k, "last": last, "piece": text[left:right], "head": start - left, "tail": stop - left}
                    yield pa.RecordBatch.from_pylist([piece], schema=fields)
                    start, k = max(stop, found - overlap), k + 1

    pieces = huge.select("row", "text").mapInArrow(lean(cut), schema)
    return pieces.repartition(F.col("row"), F.col("k"))


def own_part(at: regex.Pattern, k: int, last: bool, piece: str, head: int, tail: int) -> tuple[int, int]:
    """The range of `piece` that chunk k encodes: from the boundary after its nominal start to the one after its end."""
    start = resync(at, piece, head, len(piece)) if k else 0
    stop = len(piece) if last else resync(at, piece, tail, len(piece))
    return start, stop
