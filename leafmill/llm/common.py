"""Helpers the operators of this subpackage share: staged tables, word hashes in numpy, and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import shared_folder

#: a word, in every operator here; the class is ASCII, so it cuts UTF-8 bytes where it cuts text
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2, _POLY = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: pieces of words that are hashed at once
_SLICE = 1 << 19

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name inside the folder all executors share (`spark.checkpoint.dir`)."""
    return os.path.join(shared_folder(spark), f"{kind}-{uuid.uuid4().hex}")


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from the files: branches read them, lost executors lose nothing."""
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(files: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of files to read, one to a partition: its rows are small, so left alone they would share one task."""
    return files.repartition(max(1, min(files.count(), most)))


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder that tasks write files to, named by URI or by an absolute path."""
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")


def whole_row(columns: tuple[str, ...]) -> Column:
    """Columns to be carried along, packed so that their names meet no other."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def give_back() -> None:
    """Hand memory of finished work back to the system; Spark keeps a worker for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def lean(work):
    """Wraps a function over Arrow batches so that its worker, which Spark keeps for later tasks, gives memory back at the end."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def text_bytes(column: str | Column) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def power_of_two(x: float, least: int) -> int:
    n = least
    while n < x:
        n *= 2
    return n


def pieces_of(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about `most` text bytes (one row at least), to bound what numpy holds at once."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    block = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def joined(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts (null: empty) as one byte array, a line feed after each, and the n + 1 row offsets into it."""
    raw = [b"" if t is None else t.encode() for t in texts.to_pylist()]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in raw], out=offsets[1:])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    return (_LOWER[data] if lower else data), offsets


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.diff(_IS_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash over all of it."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word; equal words give equal hashes anywhere.

    A word is cut into pieces of eight bytes. Each piece, with its number, is mixed as a whole before the pieces are summed,
    so patterns that cancel in a polynomial don't meet here. Words are taken in slices, to bound what is held at once.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = ends - starts
    count = (length + 7) >> 3
    before = np.cumsum(count) - count
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + _SLICE)))
        n, first = count[at:to], before[at:to] - before[at]
        number = np.arange(int(n.sum())) - np.repeat(first, n)
        left = np.minimum(np.repeat(length[at:to], n) - 8 * number, 8).astype(np.uint64)
        piece = eight[np.repeat(starts[at:to], n) + 8 * number] & (_ONES >> (np.uint64(64) - np.uint64(8) * left))
        mixed = mix(mix(piece) + (number + 1).astype(np.uint64) * _POLY)
        out[at:to] = np.add.reduceat(mixed, first) + length[at:to].astype(np.uint64)
        at = to
    return mix(out)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every window of `n` consecutive word hashes; windows of a longer array, none of a shorter."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h *= _POLY
        h += words[k : k + size]
    return mix(h)


def run_starts(values: np.ndarray) -> np.ndarray:
    """True where a sorted array begins a new value."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """Sorted integers as differences in the fewest bytes each, byte plane by byte plane, so that the shuffle packs them."""
    values = values.astype(np.uint64)
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + planes.T.tobytes()


def unpack_ints(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    width, first = blob[0], np.uint64(int.from_bytes(blob[1:9], "little"))
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return first + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)
