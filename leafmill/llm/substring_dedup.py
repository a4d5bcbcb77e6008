"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, matched in Spark, merged to removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import joined, lean, mix, pack_ints, pieces_of, power_of_two, rolling, run_starts, text_bytes, unpack_ints, whole_row, word_hashes, word_spans

WINDOW = 13
#: text bytes whose windows are sorted together before the shuffle
SHEET_BYTES = 4 << 20
#: text bytes per hash bucket and per group of documents, on average
GROUP_BYTES = 4 << 20


def _windows(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all rows and the row each window starts in."""
    data, offsets = joined(texts)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    hashes = rolling(words, window)
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    inside = rows[: len(hashes)] == rows[window - 1 :]
    return hashes[inside], rows[: len(hashes)][inside]


def _group_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """The group of documents that a document is in."""
    return (mix(_unsigned(ids)) >> np.uint64(64 - bits)).astype(np.int64)


def _sheet(texts: list[pa.Array], ids: np.ndarray, window: int, bits: int) -> Iterator[dict]:
    """Rows of one sheet of documents: per hash bucket the distinct hashes, each with its smallest document, and what the
    sheet already decides, the windows of its larger documents."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(run_starts(ids[order])) - 1  # equal ids are one document
    distinct = ids[order][run_starts(ids[order])]
    hashes, docs, at = [], [], 0
    for t in texts:
        h, r = _windows(t, window)
        hashes.append(h)
        docs.append(place[at + r])
        at += len(t)
    h, d = np.concatenate(hashes), np.concatenate(docs).astype(np.uint32)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = run_starts(h)
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else d
    later = (d > least) & (first | run_starts(d))
    if later.any():
        yield from _replies(h[later], distinct[d[later]], bits)
    h, d = h[first], d[first]
    for bucket, a, b in _slices(h >> np.uint64(64 - bits)):
        used, index = np.unique(d[a:b], return_inverse=True)
        narrow = index.astype("<u1" if len(used) <= 1 << 8 else "<u2" if len(used) <= 1 << 16 else "<u4")
        yield {"bucket": bucket, "reply": False, "hashes": pack_ints(h[a:b]), "ids": pack_ints(_unsigned(distinct[used])), "which": narrow.tobytes()}


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [*np.flatnonzero(run_starts(keys)).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(keys[a]), a, b


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Order-keeping map of signed to unsigned integers."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _replies(h: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[dict]:
    """Rows that tell each group of documents which windows of which documents go."""
    groups, ids = _group_of(ids, bits), _unsigned(ids)
    order = np.lexsort((h, ids, groups))
    h, ids, groups = h[order], ids[order], groups[order]
    for group, a, b in _slices(groups):
        cuts = np.flatnonzero(run_starts(ids[a:b]))
        counts = np.diff(np.append(cuts, b - a)).astype("<u4")
        yield {"bucket": group, "reply": True, "hashes": h[a:b].astype("<u8").tobytes(), "ids": pack_ints(ids[a:b][cuts]), "which": counts.tobytes()}


_ROW = pa.schema([("bucket", pa.int64()), ("reply", pa.bool_()), ("hashes", pa.binary()), ("ids", pa.binary()), ("which", pa.binary())])
_ROW_SQL = "bucket long, reply boolean, hashes binary, ids binary, which binary"


def _rows(rows: Iterator[dict], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == at_once:
            yield pa.RecordBatch.from_pylist(held, schema=_ROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ROW)


def _decide(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One hash bucket: every document but the smallest of a hash gets a reply."""
    hashes, ids = [], []
    for batch in batches:
        for r in batch.to_pylist():
            h, known = unpack_ints(r["hashes"]), unpack_ints(r["ids"])
            which = np.frombuffer(r["which"], f"<u{len(r['which']) // len(h)}")
            hashes.append(h)
            ids.append(known[which])
    h, d = np.concatenate(hashes), np.concatenate(ids)
    del hashes, ids
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    first = run_starts(h)
    runs = np.flatnonzero(first)
    least = np.minimum.reduceat(d, runs)[np.cumsum(first) - 1]
    later = d > least
    signed = (d[later] ^ np.uint64(1 << 63)).view(np.int64)
    yield from _rows(_replies(h[later], signed, bits))


def _cover(removed: np.ndarray, n_words: int, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that the windows starting at the marked places cover."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(removed)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    inside = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
    return list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist()))


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word that a window covers whose word sequence also starts in a document with a smaller key.

    Returns one row per input row: doc_id, text (kept words joined by one space), n_words, n_removed, spans (maximal
    removed intervals of word numbers, end excluded), and, if columns are to be carried, a struct `row` of them.

    1. Sheets of 4 MB of text hash all their windows (64 bits, Rabin-Karp over word hashes) and send each distinct hash
       once, with the sheet's smallest document, to the bucket of its top bits. Equal windows inside a sheet are decided
       there, so a passage in a third of all documents sends one entry per sheet.
    2. A bucket compares the documents of equal hashes and tells the groups of the larger documents which windows go.
    3. Documents (compressed rows) meet the replies by group; windows become intervals and the kept text is built.

    Buckets and groups hold about 4 MB of text's windows each; their number follows the input. Rows with one key are one
    document: they never remove each other's windows. Only 64-bit hashes are compared, so a window is removed wrongly
    with probability (number of windows) / 2**64.

    Edge cases: null and empty texts have no words; texts under `window` words lose none; a null key is neither smaller
    nor larger than another, so its document neither removes nor loses words; an empty table gives an empty result;
    other columns are ignored unless carried. The key must be an integer.
    """
    names = ["doc_id", "text", *(["row"] if carry else [])]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([whole_row(carry)] if carry else []))
    total = rows.agg(F.sum(text_bytes("text"))).first()[0] or 0
    buckets = power_of_two(total / GROUP_BYTES, 64)
    bits = buckets.bit_length() - 1

    def hash_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sheets() -> Iterator[dict]:
            texts, ids, held = [], [], 0
            for batch in batches:
                for part in pieces_of(batch, "text", 1 << 20):
                    texts.append(part.column("text"))
                    ids.append(part.column("doc_id").to_numpy())
                    held += part.column("text").nbytes
                    if held >= SHEET_BYTES:
                        yield from _sheet(texts, np.concatenate(ids), window, bits)
                        texts, ids, held = [], [], 0
            if texts:
                yield from _sheet(texts, np.concatenate(ids), window, bits)

        yield from _rows(sheets())

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                packed = [None if t is None else pack.compress(t.encode()) for t in part.column("text").to_pylist()]
                ids = part.column("doc_id")
                # rows without a key get no replies and may be anywhere
                group = _group_of(np.where(ids.is_null(), np.arange(len(ids)), ids.fill_null(0)), bits)
                yield pa.RecordBatch.from_arrays([pa.array(group), ids, pa.array(packed, pa.binary()), *part.columns[2:]], ["bucket", *part.schema.names])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        gone: dict[int, list[np.ndarray]] = {}
        for r in right.to_pylist():
            counts = np.frombuffer(r["which"], "<u4")
            ids = (unpack_ints(r["ids"]) ^ np.uint64(1 << 63)).view(np.int64)
            for i, part in zip(ids.tolist(), np.split(np.frombuffer(r["hashes"], "<u8"), np.cumsum(counts)[:-1])):
                gone.setdefault(i, []).append(part)
        out: dict[str, list] = {"text": [], "n_words": [], "n_removed": [], "spans": []}
        for i, packed in zip(left["doc_id"].to_pylist(), left["text"].to_pylist()):
            raw = b"" if packed is None else unpack.decompress(packed)
            words = raw.split()
            spans: list[tuple[int, int]] = []
            if i in gone and len(words) >= window:
                hashes, _ = _windows(pa.array([raw.decode()]), window)
                spans = _cover(np.isin(hashes, np.concatenate(gone[i])), len(words), window)
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out["text"].append(b" ".join(kept).decode())
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        arrays = [pa.array(out["text"], pa.string()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], spans_type)]
        columns = {"doc_id": left["doc_id"]} | dict(zip(out, arrays))
        return pa.table(columns | ({"row": left["row"]} if carry else {}))

    keyed = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    hashed = keyed.mapInArrow(lean(hash_sheets), _ROW_SQL)
    # what a sheet has decided passes the buckets by: it is computed with them and split off behind
    mixed = hashed.withColumn("to", F.when(F.col("reply"), -1 - F.col("bucket")).otherwise(F.col("bucket")))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        if first.column("reply")[0].as_py():
            yield from (b.drop_columns(["to"]) for b in [first])
            yield from (b.drop_columns(["to"]) for b in batches)
        else:
            yield from _decide((b for part in ([first], batches) for b in part), bits)

    replies = mixed.groupBy("to").applyInArrow(lean(decide), _ROW_SQL).select("bucket", "hashes", "ids", "which")
    row_type = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    packed = rows.select(*names).mapInArrow(lean(compress), f"bucket long, doc_id long, text binary{row_type}")
    schema = f"doc_id long, text string, n_words long, n_removed long, spans array<struct<start: int, end: int>>{row_type}"
    return packed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(apply, schema)
