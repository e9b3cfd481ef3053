"""WARC archives as seekable Zstandard bundles.

Records are grouped into Zstandard frames that stand alone; a bundle is a file of such
frames and ends with a seek table in a skippable frame, as the public seekable format
has it. The index, a Parquet table beside the bundles, maps each record identifier to
its bundle, its frame and the offset within the frame's uncompressed bytes, so that a
reader opens a bundle, reads its seek table and decompresses only the frames it needs.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends. A longer record has a frame of its own.
FRAME, BUNDLE = 1 << 20, 256 << 20
#: Equal payloads of this many bytes and more are stored once.
REPEATED = 100
#: Uncompressed bytes that a task reads back, about.
READ = 64 << 20
INDEX = "record_id string, record_type string, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, record_type string, id string, url string, refers_to string, refers_to_id string, payload binary, payload_bytes long, payload_digest string"

# Fixed values of the seekable format: the skippable frame's and the seek table's magic numbers, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
END = b"\r\n\r\n"


def storage(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder that Spark names by path or URI, and the path in it."""
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", folder)))


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame that lists (compressed size, uncompressed size, checksum) of all frames before it."""
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Bundle:
    """A bundle that is read by its seek table."""

    def __init__(self, name: str):
        fs, path = storage(name)
        self.file, self.unpack = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} does not end with a seek table")
        width = 12 if flags & CHECKSUMS else 8
        entries = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, start = [], 0
        for k in range(n):
            packed, full = struct.unpack_from("<II", entries, k * width)
            self.frames.append((start, packed, full, struct.unpack_from("<I", entries, k * width + 8)[0] if width == 12 else None))
            start += packed

    def frame(self, k: int) -> bytes:
        start, packed, full, checksum = self.frames[k]
        data = self.unpack.decompress(self.file.read_at(packed, start), max_output_size=full)
        if len(data) != full or checksum not in (None, xxhash.xxh64_intdigest(data) & 0xFFFFFFFF):
            raise ValueError(f"frame {k} is damaged")
        return data

    def close(self) -> None:
        self.file.close()


class Bundles:
    """Bundles as a task writes them, one after another; ``rows`` are index entries not yet handed on."""

    def __init__(self, folder: str, date: str, frame: int, bundle: int):
        self.folder, self.date, self.most, self.full = folder, date, frame, bundle
        self.fs, self.path = storage(folder)
        self.pack, self.file, self.rows, self.buffer = zstandard.ZstdCompressor(level=3), None, [], bytearray()

    def add(self, record: bytes, ident: str, kind: str) -> None:
        if self.file is None:
            self.name, self.frames, self.at = f"bundle-{uuid.uuid4().hex}.warc.zst", [], 0
            self.file = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.buffer += record_bytes("warcinfo", f"urn:uuid:{uuid.uuid4()}", self.date, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            self.end_frame()
        if self.buffer and len(self.buffer) + len(record) > self.most:
            self.end_frame()
        self.rows.append((ident, kind, f"{self.folder}/{self.name}", len(self.frames), len(self.buffer), len(record)))
        self.buffer += record
        if len(self.buffer) >= self.most:
            self.end_frame()
        if self.at >= self.full:
            self.close()

    def end_frame(self) -> None:
        if self.buffer:
            data = bytes(self.buffer)
            packed = self.pack.compress(data)
            self.file.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.at += len(packed)
            self.buffer.clear()

    def close(self) -> None:
        if self.file is not None:
            self.end_frame()
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in INDEX.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        rows, self.rows = self.rows, []
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def record_bytes(kind: str, ident: str, date: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": date} | fields | {"Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + END


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of uncompressed bytes: fields by lower-case name, and the block."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record begins here")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + len(END)


def record_id(ident: str | None, digest: str) -> str:
    """A row's record identifier. Repeated rows, which are equal in id and payload, share it."""
    return f"urn:plumeworks:{'none' if ident is None else 'id.' + quote(ident, safe='')}:{digest[:32]}"


def page_record(ident: str | None, url: str | None, payload: bytes, digest: str, revisit: bool, first: str | None, date: str) -> tuple[str, str, bytes]:
    """(record id, type, bytes) of a page: a response with its payload, or a revisit that names the response and holds none."""
    name = record_id(ident, digest)
    fields = {"WARC-Target-URI": name if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url), "WARC-Payload-Digest": f"sha256:{digest}"}
    if ident is not None:
        fields["X-Row-Id"] = quote(ident, safe="")
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{record_id(first, digest)}>", "X-Refers-To-Row-Id": quote(first, safe=""), "X-Payload-Length": str(len(payload))}
        return name, "revisit", record_bytes("revisit", name, date, fields, b"")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return name, "response", record_bytes("response", name, date, fields | {"Content-Type": "application/http; msgtype=response"}, block)


def write(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", payload: str = "html", frame: int = FRAME, bundle: int = BUNDLE, date: str | None = None) -> DataFrame:
    """Archives all pages under ``folder``, a path or URI that all executors share, and returns the index.

    Of equal payloads of REPEATED bytes and more, the row with the smallest id is a
    response, others are revisits of it; shorter payloads are all responses. A null
    payload is empty, a null url is replaced by the record's id, a null id comes after
    all others. Rows equal in id and payload to a response are responses too. An empty
    table gives an empty index; other columns are not read, whatever their names.

    Payloads are shuffled at most once, and not at all while the table of repeated
    digests is small enough for Spark to broadcast it by its size on disk. A task that
    runs again writes bundles anew; the index names those of committed tasks only.
    """
    spark = pages.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    row = pages.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = row.where(F.octet_length("payload") >= REPEATED).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    repeated.select("digest", "first").write.parquet(f"{folder}/repeated")
    joined = row.join(spark.read.parquet(f"{folder}/repeated"), "digest", "left")
    typed = joined.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"), F.col("first").cast("string").alias("first"))
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Bundles(f"{folder}/bundles", when, frame, bundle)
        out.fs.create_dir(out.path, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                i, u, p, d, again, first = (c[k].as_py() for c in batch.columns)
                name, kind, data = page_record(i, u, p, d, again, first, when)
                out.add(data, name, kind)
            yield out.take()
        out.close()

    typed.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, name = fields["warc-type"], fields["warc-record-id"][1:-1]
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    own, other, url = fields.get("x-row-id"), fields.get("x-refers-to-row-id"), fields["warc-target-uri"]
    body = None if kind == "revisit" else block[block.index(END) + len(END) :]
    digest = stated if body is None else hashlib.sha256(body).hexdigest()
    if digest != stated:
        raise ValueError(f"the payload of {name} is damaged")
    size = int(fields["x-payload-length"]) if body is None else len(body)
    refers = fields["warc-refers-to"][1:-1] if kind == "revisit" else None
    return name, kind, own and unquote(own), None if url == name else url, refers, other and unquote(other), body if payloads else None, size, digest


def read(index: DataFrame, payloads: bool = True, most: int = READ) -> DataFrame:
    """The records that index rows name, from their bundles: RECORDS, with null in place of payloads where these are not wanted.

    index: all that ``write`` returns, or any rows of it, as ``find`` gives them. Each
    response's digest is computed anew from what was read and held against its header;
    a revisit has no payload and gives the size and digest that its header states. Rows
    are dealt to tasks by bundle and run of frames; a frame is decompressed once in a task.
    """
    spark = index.sparkSession
    small_batches(spark)
    of = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-of["size"] // most))
    run_of = F.floor(F.col("frame") / max(1, READ // FRAME // 8))
    dealt = index.select("bundle", "frame", "offset", "length").repartition(parts, "bundle", run_of).sortWithinPartitions("bundle", "frame", "offset")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.string()] * 6 + [pa.binary(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at, rows, size = None, (None, None), [], 0
        for b in batches:
            for name, frame, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if at[0] != name:
                    if opened is not None:
                        opened.close()
                    opened, at = Bundle(name), (name, None)
                if at[1] != frame:
                    data, at = opened.frame(frame), (name, frame)
                rows += [_row(*r, payloads) for r in parse(data[offset : offset + length])]
                size += length
                if size >= 8 << 20 or len(rows) >= 1000:
                    yield batch(rows)
                    rows, size = [], 0
        if opened is not None:
            opened.close()
        yield batch(rows)

    return dealt.mapInArrow(run, RECORDS)


def find(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index rows of the record ids in the first column of ``ids``; unknown ids and nulls give none, repeated ids no more than one."""
    (wanted,) = fresh(index, "wanted")
    return index.join(ids.select(F.col(f"`{ids.columns[0]}`").alias(wanted)).distinct(), F.col("record_id") == F.col(wanted), "left_semi")
