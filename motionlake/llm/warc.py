"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of bounded size; a footer in a skippable frame lists the sizes of all
frames, and an index maps each record to its bundle, frame and offset in the frame, so a reader decompresses the one
frame that holds a record. Of records with equal payloads the one with the largest key is the response and the others
are revisits without a payload. Payloads are compared by digest, with the largest key of each digest found by a
partial aggregate; only digests that occur twice are joined back, and a frequent digest is split like any skewed join.

Edge cases: null payload and null URL count as empty; a null key is a response of its own (or a revisit, if its payload
has a response elsewhere); rows that repeat a key and its payload are responses alike; an empty table gives an empty
index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written
from .files import new_file, open_file

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, size long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload and refers_to: the key of the response that a revisit stands for, else null."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last"))
    return rows.join(last, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:motionlake:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames of records, then the seek table."""

    def __init__(self, folder: str):
        self.out, self.uri = new_file(folder, ".warc.zst")
        self.pack, self.frames, self.open, self.size, self.written = zstandard.ZstdCompressor(level=3), [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame that the record goes to and its offset there."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self.end_frame()
        at = len(self.frames), self.size
        self.open.append(record)
        self.size += len(record)
        return at

    def end_frame(self) -> None:
        packed = self.pack.compress(b"".join(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self.end_frame()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """Offset, packed size and full size of each frame."""
    end = f.size()
    f.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(end - 9 - 8 * count)
    sizes = struct.iter_unpack("<II", f.read(8 * count))
    table, at = [], 0
    for packed, full in sizes:
        table.append((at, packed, full))
        at += packed
    return table


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write what with_revisits() gave to bundles in folder; the index, itself written to the shared folder."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(folder)
                record = record_bytes(page_id, url, payload, refers_to)
                rows.append((record_uri(page_id), page_id, bundle.uri, *bundle.add(record), len(record)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows and bundle is None:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if bundle:
            bundle.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return written(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "warc-index")


def parse_record(data: bytes) -> tuple[int | None, str, int | None, int, str, str | None, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: None if uri is None or uri.endswith(":none>") else int(uri.rpartition(":")[2][:-1])
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return number(fields["WARC-Record-ID"]), kind, number(fields.get("WARC-Refers-To")), size, digest, fields.get("WARC-Target-URI"), payload


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index names (RECORD); without payloads that column is null."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, uri, file, table, at, frame = zstandard.ZstdDecompressor(), None, None, [], None, b""
        for batch in batches:
            rows = []
            for bundle, number, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != uri:
                    if file:
                        file.close()
                    uri, file = bundle, open_file(bundle)
                    table, at = seek_table(file), None
                if number != at:
                    start, packed, full = table[number]
                    file.seek(start)
                    at, frame = number, unpack.decompress(file.read(packed), max_output_size=full)
                row = parse_record(frame[offset : offset + size])
                rows.append(row if payloads else (*row[:-1], None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if file:
            file.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = index.select("bundle", "frame", "offset", "size").repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return frames.mapInArrow(run, RECORD)


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write pages to bundles under the shared folder; the index."""
    return write_archives(with_revisits(pages, key, payload, url), new_folder(pages.sparkSession, "warc"))
