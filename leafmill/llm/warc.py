"""WARC archives: records written by tasks to shared files, read back as a table of payload chunks with running digests."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import dealt_out, lean, new_folder, open_folder

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
MIN_DUPLICATE_BYTES = 0

#: fixed values of the WARC/1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header_text(value: object) -> str:
    """A header value on one line: line ends and per cent signs are escaped, so that any text survives."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain_text(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


class _Archive:
    """One file of gzip members, a member for every record; payloads are compressed in slices."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.path, self.records, self.bytes = path, 0, 0
        self._out = system.open_output_stream(path)

    def write(self, headers: list[tuple[str, str]], payload: memoryview) -> None:
        lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(pack.compress(VERSION + b"\r\n" + lines + f"Content-Length: {len(payload)}\r\n\r\n".encode()))
        for at in range(0, len(payload), CHUNK_BYTES):
            self._put(pack.compress(payload[at : at + CHUNK_BYTES]))
        self._put(pack.compress(b"\r\n\r\n") + pack.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        self._out.write(data)

    def close(self) -> dict:
        self._out.close()
        return {"archive": self.path, "records": self.records, "bytes": self.bytes}


def mark_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """(page_id, url, payload, sha1, n_bytes, refers_to): of equal payloads of at least `min_bytes` bytes all but those
    of the smallest page_id refer to it. Only digests of payloads found twice or more are joined back."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    groups = rows.select("sha1", "n_bytes", "page_id").where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes")
    first = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(first, ["sha1", "n_bytes"], "left")
    return marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(marked: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes what `mark_revisits` gives as .warc.gz files below `folder`, a path that all executors share, and returns
    the manifest (archive, records, bytes), itself a table in that folder.

    Every task writes files of its own under new names and starts the next at `archive_bytes`. The manifest is written by
    Spark's commit, so a lost or repeated task leaves files that no manifest names and no reader opens. A response holds
    the payload; a revisit holds headers only, among them the length and digest of the full payload.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(folder)
        system.create_dir(top, recursive=True)
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "n_bytes", "sha1", "refers_to")]
            for i in range(batch.num_rows):
                page, url, n, sha1, refers = (columns[k][i].as_py() for k in (0, 1, 3, 4, 5))
                archive = archive or _Archive(system, f"{top}/{uuid.uuid4().hex}.warc.gz")
                archive.write(*record(page, url, memoryview(columns[2][i].as_buffer()), n, bytes.fromhex(sha1), refers))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    manifest = f"{folder}/manifest"
    marked.mapInArrow(lean(write), "archive string, records long, bytes long").write.parquet(manifest)
    return marked.sparkSession.read.schema("archive string, records long, bytes long").parquet(manifest)


def record_id(page: int | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}:{sha1.hex()}')}>"


def record(page: int | None, url: str | None, payload: memoryview, n_bytes: int, sha1: bytes, refers: int | None) -> tuple[list[tuple[str, str]], memoryview]:
    """Headers and body of one record."""
    revisit = refers is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, sha1)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(sha1)}"),
        ("X-Payload-Length", str(n_bytes)),
    ]
    headers += [] if url is None else [("WARC-Target-URI", header_text(url))]
    headers += [] if page is None else [("X-Page-ID", str(page))]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers, sha1)), ("X-Refers-To-Page-ID", str(refers))]
    return headers, memoryview(b"") if revisit else payload


def read_records(stream: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Payload chunks of all records of one archive, in order, with the digest and length so far.

    A record gives a row per chunk of `chunk_bytes`, the last one marked; a record with an empty body gives one row. No
    more than a chunk and a read buffer is held, however large the record.
    """
    plain = _Plain(stream)
    while True:
        offset = plain.place
        line = plain.line()
        if line is None:
            return
        if line != VERSION:
            raise ValueError(f"no record at {offset}")
        headers: dict[str, str] = {}
        while line := plain.line():
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        left, digest, so_far, number = int(headers["content-length"]), hashlib.sha1(), 0, 0
        while True:
            data = plain.take(min(left, chunk_bytes))
            left -= len(data)
            so_far += len(data)
            digest.update(data)
            yield {"offset": offset, "headers": headers, "chunk_no": number, "data": data, "bytes_so_far": so_far, "digest_so_far": base32_sha1(digest.digest()), "last": not left}
            number += 1
            if not left:
                break
        if plain.take(4) != b"\r\n\r\n":
            raise ValueError(f"record at {offset} has no end")


class _Plain:
    """Reads a stream of gzip members as plain bytes, a buffer at a time."""

    def __init__(self, stream: BinaryIO, buffer: int = 1 << 18):
        self.place, self._stream, self._size = 0, stream, buffer
        self._unpack, self._rest, self._held = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if self._unpack.eof:
            self._rest, self._unpack = self._unpack.unused_data, zlib.decompressobj(31)
        data = self._unpack.unconsumed_tail or self._rest or self._stream.read(self._size)
        self._rest = b""
        if not data:
            return False
        self._held += self._unpack.decompress(data, self._size)
        return True

    def take(self, n: int) -> bytes:
        while len(self._held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self._held[:n])
        del self._held[:n]
        self.place += n
        return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (end := self._held.find(b"\r\n")) < 0:
            if not self._more():
                if self._held:
                    raise ValueError("the archive ends inside a line")
                return None
        return self.take(end + 2)[:-2]


CHUNK_TABLE = (
    "archive string, record_offset long, record_id string, record_type string, page_id long, url string, refers_to long, chunk_no int, "
    "data binary, bytes_so_far long, payload_bytes long, digest_so_far string, payload_digest string, last boolean"
)


def read_archives(manifest: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives a manifest names: one row per record and chunk number.

    `digest_so_far` and `bytes_so_far` run over a record's chunks; on the last chunk `payload_bytes` and `payload_digest`
    are those of the full payload, which a revisit takes from its headers. A response whose body doesn't match the digest
    in its headers stops the job. `data` is null with `with_data=False`; every byte is read and digested all the same.

    Archives are dealt to tasks one by one; a task streams its archive and holds a chunk at a time.
    """
    spark = manifest.sparkSession
    schema = spark.createDataFrame([], CHUNK_TABLE).schema
    arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}.get(f.dataType.simpleString(), pa.string())) for f in schema])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                system, _ = open_folder(batch.column("folder")[0].as_py())
                rows, held = [], 0
                with system.open_input_stream(path) as stream:
                    for r in read_records(stream, chunk_bytes):
                        rows.append(chunk_row(path, r, with_data))
                        held += len(rows[-1]["data"] or b"")
                        if held >= 4 * chunk_bytes or len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    names = manifest.select("archive", F.col("folder") if "folder" in manifest.columns else F.lit("file:///").alias("folder"))
    return dealt_out(names).mapInArrow(lean(read), schema)


def chunk_row(path: str, r: dict, with_data: bool) -> dict:
    h = r["headers"]
    revisit = h["warc-type"] == "revisit"
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if r["last"] and not revisit and (digest, int(h["x-payload-length"])) != (r["digest_so_far"], r["bytes_so_far"]):
        raise ValueError(f"{h['warc-record-id']} in {path} has another digest or length than its headers say")
    number = lambda name: int(h[name]) if name in h else None
    return {
        "archive": path, "record_offset": r["offset"], "record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"],
        "page_id": number("x-page-id"), "url": plain_text(h["warc-target-uri"]) if "warc-target-uri" in h else None, "refers_to": number("x-refers-to-page-id"),
        "chunk_no": r["chunk_no"], "data": r["data"] if with_data else None, "bytes_so_far": r["bytes_so_far"], "digest_so_far": r["digest_so_far"],
        "payload_bytes": int(h["x-payload-length"]) if r["last"] else None, "payload_digest": digest if r["last"] else None, "last": r["last"],
    }


def archive_pages(pages: DataFrame, folder: str | None = None, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_DUPLICATE_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one WARC record per row and returns the manifest (archive, records, bytes, folder).

    Edge cases: a null payload is empty; null url or page_id leave their header out; a page_id of null is no smallest
    one, so such a row revisits an equal payload that has an id; rows that repeat the smallest page_id are all
    responses; an empty table writes no archive and gives an empty manifest; other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    marked = mark_revisits(pages, key=key, url=url, payload=payload, min_bytes=min_bytes)
    return write_archives(marked, folder, archive_bytes=archive_bytes).withColumn("folder", F.lit(folder))
