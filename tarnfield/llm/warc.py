"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records, followed by a skippable frame with the seek table: every frame's
compressed and decompressed size. An index row maps a record's identifier to its
bundle, frame and offset within the frame, so one record is read by one seek and
one frame's decompression. Records of equal payload (of at least `min_bytes`)
are stored once: the smallest identifier is the response, the others are
revisit records that name it.

Bundles are written under a name of the attempt's own and moved into place; the
index that a finished attempt returns is written as a table, and only bundles
that it names are read, so a lost executor leaves at most an unread file.

Defined results: a null payload is empty. Rows that repeat an identifier are
records of their own; the first stays a response to itself and equal ones are
responses too, as a record can't revisit itself. A null identifier is written as
an empty field and never owns a payload. An empty table writes no bundle. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.shared import blocks_of, stored, work_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 64 << 20
#: Frames of a bundle that one row of the reader's input stands for.
FRAMES_A_RANGE = 32
INDEX = "page_id long, bundle string, frame int, at long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _record_uuid(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in uri or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_uuid(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_uuid(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, payload, end) of the record that begins at `at`."""
    raw = bytes(raw) if at == 0 and not isinstance(raw, bytes) else raw
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    body = raw.index(b"\r\n\r\n", begin, end) + 4
    http = raw[begin:body].decode()
    fields["payload-length"] = http.split("Content-Length: ", 1)[1].split("\r\n", 1)[0]
    return fields, raw[body:end], end + 4


class BundleWriter:
    """Writes records into frames of one bundle; close() appends the seek table."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.path, self.uri = posixpath.join(base, self.name), f"{folder}/{self.name}"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.frame_bytes, self.pending, self.frames, self.written = frame_bytes, bytearray(), [], 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        if self.pending and len(self.pending) + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.frames), len(self.pending)
        self.pending += record
        return at

    def _flush(self) -> None:
        frame = self.zstd.compress(bytes(self.pending))
        self.out.write(frame)
        self.frames.append((len(frame), len(self.pending)))
        self.written += len(frame)
        self.pending = bytearray()

    def close(self) -> None:
        if self.pending:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, raw = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, raw = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)

    def record(self, frame: int, at: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), at)[:2]


def with_owners(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to. Only identifiers and digests are dealt by digest; payloads are dealt by identifier."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    light = stored(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "digests").where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    owners = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    revisits = light.join(owners, "digest").where("page_id > refers_to").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct()
    return rows.join(revisits, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes every page into bundles under `folder`; returns the index, itself a written table."""
    folder = folder or work_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []

        def done() -> pa.RecordBatch:
            writer.close()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["page_id", "bundle", "frame", "at", "length"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or BundleWriter(folder, frame_bytes)
                record = build_record(page_id, url, payload, digest, refers_to)
                frame, at = writer.add(record)
                rows.append((page_id, writer.uri, frame, at, len(record)))
                if writer.written >= bundle_bytes:
                    yield done()
                    writer, rows = None, []
        if rows:
            yield done()

    return stored(with_owners(pages, min_bytes).mapInArrow(run, INDEX), "index")


def read_archives(spark: SparkSession, index: DataFrame, frames: int = FRAMES_A_RANGE) -> DataFrame:
    """Every record of the frames that an index names, digests recomputed from the payloads read.

    Ranges of `frames` neighbouring frames are dealt evenly to as many tasks as the session has shuffle partitions; a task seeks
    its ranges by the seek table, so a large bundle is read by many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = BundleReader(uri)
                for i in range(part * frames, min((part + 1) * frames, len(reader.frames))):
                    raw, at, out = reader.frame(i), 0, []
                    while at < len(raw):
                        fields, payload, at = parse_record(raw, at)
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{uri}, frame {i}: a payload differs from its digest")
                        own, other = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                        out.append((int(own) if own else None, int(fields["payload-length"]), digest, fields["WARC-Type"], int(other) if other else None, fields["WARC-Target-URI"]))
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.int64()), pa.array(cols[5])], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"])

    ranges = index.select("bundle", F.floor(F.col("frame") / frames).cast("long").alias("part")).distinct()
    # dealt in turn: a repartition by the same columns would be left out as done by distinct, whose few bytes are laid together in one task
    return ranges.repartition(blocks_of(spark)).mapInArrow(run, RECORD)


def lookup(index: DataFrame, page_ids: list[int]) -> list[tuple[int, dict[str, str], bytes]]:
    """The records of a few identifiers, each read by one seek."""
    rows = index.where(F.col("page_id").isin(page_ids)).collect()
    return [(r.page_id, *BundleReader(r.bundle).record(r.frame, r.at)) for r in rows]
