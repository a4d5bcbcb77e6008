"""Token-id shards as wavelet matrices: succinct bit planes with rank and select in one file per shard."""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import dealt_out, lean, new_folder, open_folder, pack_ints, pieces_of, unpack_ints

MAGIC = b"WVLT0001"
SHARD_TOKENS = 4 << 20
#: bits between two entries of a rank directory
BLOCK = 512


class WaveletMatrix:
    """A sequence of token ids as bit planes, most significant first, over the ids in use.

    `planes[l]` holds bit l of every id (8 words of 64 bits a block), `ranks[l]` the ones before each block and
    `zeros[l]` the number of zeros. Every question is answered from these arrays, which are views of the file's bytes.
    """

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.alphabet, self.planes, self.ranks, self.zeros = n, alphabet, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        used = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used)
        code = np.zeros(len(used), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        rest, planes, ranks, zeros = code[ids], [], [], []
        for bit in reversed(range(max(len(alphabet) - 1, 0).bit_length())):
            ones = (rest >> bit) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(-(-len(ones) // BLOCK) * 8, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            per_block = np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.int64)
            planes.append(words)
            ranks.append(np.append(0, np.cumsum(per_block)).astype("<u4"))
            zeros.append(len(ones) - int(ranks[-1][-1]))
            rest = np.concatenate([rest[~ones], rest[ones]])
        return cls(len(ids), alphabet, planes, ranks, zeros)

    def rank(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        block, inside = places // BLOCK, places % BLOCK
        words = self.planes[level].reshape(-1, 8)[np.minimum(block, len(self.planes[level]) // 8 - 1)]
        bits = np.clip(inside[:, None] - 64 * np.arange(8), 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def _bit(self, level: int, places: np.ndarray) -> np.ndarray:
        return (self.planes[level][places // 64] >> (places % 64).astype(np.uint64)) & np.uint64(1) == 1

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        places, code = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for level in range(len(self.planes)):
            one, ahead = self._bit(level, places), self.rank(level, places)
            code = 2 * code + one
            places = np.where(one, self.zeros[level] + ahead, places - ahead)
        return self.alphabet[code]

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of a token in [start, stop) stand below the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        ends = np.array([start, stop], np.int64)
        for level in range(len(self.planes)):
            ahead = self.rank(level, ends)
            ends = self.zeros[level] + ahead if code >> (len(self.planes) - 1 - level) & 1 else ends - ahead
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token occurs in [start, stop)."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def select(self, level: int, bit: int, numbers: np.ndarray) -> np.ndarray:
        """Places of the numbered (from 0) ones or zeros of a plane."""
        low, high = np.zeros(len(numbers), np.int64), np.full(len(numbers), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            ones = self.rank(level, np.minimum(middle + 1, self.n))
            enough = (ones if bit else np.minimum(middle + 1, self.n) - ones) > numbers
            high = np.where(enough, middle, high)
            low = np.where(enough | (low >= high), low, middle + 1)
        return low

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        a, b = self._range(token, 0, self.n)
        places, code = np.arange(a, b, dtype=np.int64), int(np.searchsorted(self.alphabet, token))
        for level in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - level) & 1
            places = self.select(level, bit, places - (self.zeros[level] if bit else 0))
        return places

    def ids(self) -> np.ndarray:
        """The whole sequence, by putting the planes back in order from the last to the first."""
        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(code)
            before[~ones] = code[: self.zeros[level]]
            before[ones] = code[self.zeros[level] :] | (1 << (len(self.planes) - 1 - level))
            code = before
        return self.alphabet.astype("<u4")[code]


def to_file(matrix: WaveletMatrix, docs: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """Magic, header length, JSON header, then 8-byte aligned parts: documents, alphabet, and each plane with its ranks."""
    ends = pack_ints(np.cumsum(lengths))
    parts = [docs.astype("<i8").tobytes(), np.packbits(known).tobytes(), ends, matrix.alphabet.astype("<u4").tobytes()]
    for words, ranks in zip(matrix.planes, matrix.ranks):
        parts += [words.tobytes(), ranks.tobytes()]
    header = json.dumps({"tokens": matrix.n, "documents": len(docs), "zeros": matrix.zeros, "parts": [len(p) for p in parts]}).encode()
    head = MAGIC + len(header).to_bytes(8, "little") + header
    return b"".join(p + bytes(-len(p) % 8) for p in [head, *parts])


def from_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, and the documents' keys, which of them are known (not null), and their lengths."""
    if data[:8] != MAGIC:
        raise ValueError("no token shard")
    size = int.from_bytes(data[8:16], "little")
    header, at, parts = json.loads(data[16 : 16 + size]), 16 + size + -(16 + size) % 8, []
    for n in header["parts"]:
        parts.append(data[at : at + n])
        at += n + -n % 8
    docs = np.frombuffer(parts[0], "<i8")
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=len(docs)).view(bool)
    lengths = np.diff(unpack_ints(parts[2]).astype(np.int64), prepend=0)
    planes, ranks = [np.frombuffer(p, "<u8") for p in parts[4::2]], [np.frombuffer(p, "<u4") for p in parts[5::2]]
    return WaveletMatrix(header["tokens"], np.frombuffer(parts[3], "<u4").astype(np.int64), planes, ranks, header["zeros"]), docs, known, lengths


#: letters that are their own composed form and have a lower case that depends on nothing around them
PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")
#: characters that are cut from the letters in front of them
MARKS = b".,*$%&"


class WordCache(dict):
    """Encodes texts word by word and keeps the ids of up to `LIMIT` words; the rest are encoded every time.

    Only for tokenizers that drop white space and never join text across it, lower-case, and cut letters from other
    characters; this is checked. Then the ids of a text are those of its words, one after the other; a plain word and
    the `MARKS` behind it are encoded apart; and the model takes a plain word's bytes as they are. Any other word takes
    the library's whole way.
    """

    LIMIT = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        if hasattr(self._model, "_resize_cache"):
            self._model._resize_cache(0)  # every word comes here once, so the model's own cache only costs time
        # the visible character that stands for each byte in a byte-level vocabulary, of a character's last or first byte
        spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = lambda code: spelling.pre_tokenize_str(chr(code))[0][0]
        self._spelled = {i: shown(i)[-1] for i in range(0xC0)} | {0xC0 + i: shown(0x40 * i)[0] for i in range(2, 0x20)}
        self.kind = np.dtype("<u2" if self._whole.get_vocab_size() <= 1 << 16 else "<u4")
        self._after: dict[bytes, bytes] = {}
        sample = "Ab1, c'd  e\t\nf-g <|x|> \u00c9t\u00e9. \u01d5lt, w\u00fcrde zz, \u00d7 Q. \u0130 a\u0301. \u00ff\u0100 Ab*** \u00e9t&&& zz,$$$ q.. W%%%.,* \u00d7&."
        if self._whole.encode(sample, add_special_tokens=False).ids != self.encode([sample])[0].tolist():
            raise ValueError(f"{path} can't be used word by word")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def _library(self, text: str) -> bytes:
        return self._pack(self._whole.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if stem.isalpha():  # of bytes: ASCII letters only
            low = stem.lower()
            spelled = low.decode()
        elif stem and PLAIN.fullmatch(text := stem.decode()):
            low = text.lower().encode()
            spelled = low.decode("latin-1").translate(self._spelled)
        else:
            return self._keep(word, self._library(word.decode()))
        ids = self.get(low)
        if ids is None:
            ids = self._keep(low, self._pack([t.id for t in self._model.tokenize(spelled)]))
        if len(stem) < len(word):
            marks = word[len(stem) :]
            behind = self._after.get(marks)
            if behind is None:
                behind = self._library(marks.decode())
                if len(self._after) < self.LIMIT // 10:
                    self._after[marks] = behind
            ids += behind
        return self._keep(word, ids)

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        if len(self) < self.LIMIT:
            self[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids = self.__getitem__
        return [np.frombuffer(b"".join(map(ids, (t or "").encode().split())), self.kind) for t in texts]


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int = 1, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes every text, ends each document with `end_id`, and writes the ids in ascending key order as shard files.

    Returns the manifest, itself a table in the shared folder: path, folder, start (ids in all shards before it),
    n_tokens, n_docs. Texts are range-partitioned by key once; each task streams its sorted range and closes a file every
    `shard_tokens` ids, so neither a task nor a file grows with the input. The starts are sums over a task's files and
    over the tasks' totals (one row per task). File names are new for every attempt; only files in the manifest count.

    Edge cases: null and empty texts hold the end id alone; a null key comes last; repeated keys stand side by side,
    ordered by a hash of the text; an empty table gives an empty manifest; other columns are ignored.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
    types = "part int, number int, path string, n_tokens long, n_docs long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (system, top) = word_cache(tokenizer_path), open_folder(folder)
        system.create_dir(top, recursive=True)
        end = np.array([end_id], cache.kind)
        keys, runs, held, number, part = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            path = f"{top}/{uuid.uuid4().hex}.tokens"
            known = np.array([k is not None for k in keys])
            matrix = WaveletMatrix.build(np.concatenate(runs))
            with system.open_output_stream(path) as out:
                out.write(to_file(matrix, np.array([k or 0 for k in keys]), known, np.array([len(r) for r in runs])))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "n_tokens": matrix.n, "n_docs": len(keys)}], schema=fields)

        for batch in batches:
            for piece in pieces_of(batch, "text", 1 << 20):
                part = piece.column("part")[0].as_py()
                for doc, ids in zip(piece.column("doc_id").to_pylist(), cache.encode(piece.column("text").to_pylist())):
                    keys.append(doc)
                    runs.append(np.concatenate([ids, end]))
                    held += len(ids) + 1
                    if held >= shard_tokens:
                        yield close()
                        keys, runs, held, number = [], [], 0, number + 1
        if keys:
            yield close()

    path = f"{folder}/manifest"
    ordered.mapInArrow(lean(write), types).write.parquet(path)
    files = docs.sparkSession.read.schema(types).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return files.withColumn("inside", inside).join(before, "part").select("path", F.lit(folder).alias("folder"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "n_docs")


def read_shards(manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), ids (those bytes; null with `with_ids=False`). Shards are dealt to tasks; a task holds one at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, _ = open_folder(r["folder"])
                with system.open_input_stream(r["path"]) as stream:
                    matrix, docs, known, lengths = from_file(stream.read())
                data, ends = matrix.ids().tobytes(), np.cumsum(lengths)
                runs = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, mask=~known), "start": pa.array(r["start"] + ends - lengths), "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in runs], pa.int64()), "ids": pa.array(runs if with_ids else [None] * len(runs), pa.binary()),
                })

    return dealt_out(manifest).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
