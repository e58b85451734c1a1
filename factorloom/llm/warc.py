"""WARC records in seekable Zstandard bundles.

Each page becomes a WARC 1.1 record. Records are grouped into independent Zstandard frames,
frames into bundles; a bundle ends with two skippable frames: an index that maps record
identifiers to (frame, offset within the decompressed frame, length), and the seek table of
the seekable format (sizes of each frame, frame count, magic number). Bundles are rows of a
table in the shared folder, written by Spark's committer, so a lost executor costs a task.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the
largest page_id is the response; the others are revisit records without payload that name it.

Defined results: a null html is the empty payload; a null url gives a record without target
URI; smaller payloads are always responses; repeated rows of one page_id are the same record
and both responses if they hold the largest page_id; an empty table gives no bundle; rows
without page_id are responses with an identifier of their own; other columns are ignored,
whatever their names. Payloads of any length are one record each.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import as_bytes, materialize, small_batches

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 16 << 20
#: Pages have no date; records need one.
DATE = b"2024-01-01T00:00:00Z"
_ENTRY = struct.Struct("<qIIIB")  # page id, frame, offset, length, whether the id is null


def _line(value: bytes) -> bytes:
    return value.replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def record(page_id: int | None, url: bytes | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    revisit = fields[b"WARC-Type"] == b"revisit"
    return {
        "type": fields[b"WARC-Type"].decode(),
        "url": fields.get(b"WARC-Target-URI"),
        "digest": fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(),
        "payload_bytes": size,
        "refers_to": int(fields[b"WARC-Refers-To"][len(b"<urn:page:") : -1]) if revisit else None,
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """Collects records; ``finish()`` gives the bundle."""

    def __init__(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[bytes] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append(_ENTRY.pack(page_id or 0, len(self.frames), self.open_bytes, len(raw), page_id is None))
        self.open.append(raw)
        self.open_bytes += len(raw)
        if self.open_bytes >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            self.frames.append((self.zstd.compress(b"".join(self.open)), self.open_bytes))
            self.bytes += len(self.frames[-1][0])
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        index = b"".join(self.index)
        seek = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        return b"".join(f for f, _ in self.frames) + struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


class BundleReader:
    """Random access to the records of a bundle through its seek table and index."""

    def __init__(self, bundle: bytes):
        frames, _, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("the bundle has no seek table")
        start = len(bundle) - 9 - 8 * frames
        at, self.spans = 0, []
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", bundle, start + 8 * i)
            self.spans.append((at, packed, plain))
            at += packed
        kind, size = struct.unpack_from("<II", bundle, at)
        if kind != SKIPPABLE_INDEX:
            raise ValueError("the bundle has no record index")
        self.index = [(None if null else page, frame, offset, n) for page, frame, offset, n, null in _ENTRY.iter_unpack(bundle[at + 8 : at + 8 + size])]
        self.bundle, self.zstd, self.at, self.plain = bundle, zstandard.ZstdDecompressor(), -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.at:
            start, packed, plain = self.spans[frame]
            self.at, self.plain = frame, self.zstd.decompress(self.bundle[start : start + packed], max_output_size=plain)
        return self.plain[offset : offset + length]


def write_bundles(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """Write pages(page_id, url, html) as bundles; returns the table (bundle binary, records long)."""
    small_batches(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.sha2(F.encode(html, "UTF-8"), 256).alias("content"), F.octet_length(html).alias("size"))
    # Partial aggregation leaves one row for each content and task, however hot it is. Only
    # contents with several pages go on to the join, which adaptive execution splits if skewed.
    last = rows.where(F.col("size") >= min_revisit_bytes).groupBy("content").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = rows.join(last, "content", "left").select("page_id", "url", "html", "digest", F.when(F.col("response_id") != F.col("page_id"), F.col("response_id")).alias("refers_to"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BundleWriter()
        for b in batches:
            urls = b["url"].cast(pa.binary()).to_pylist()
            for page, url, payload, digest, refers in zip(b["page_id"].to_pylist(), urls, as_bytes(b["html"]), b["digest"].to_pylist(), b["refers_to"].to_pylist(), strict=True):
                out.add(page, record(page, url, payload, digest, refers))
                if out.bytes >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pydict({"records": pa.array([len(out.index)], pa.int64()), "bundle": pa.array([out.finish()], pa.binary())})
                    out = BundleWriter()
        if out.index:
            yield pa.RecordBatch.from_pydict({"records": pa.array([len(out.index)], pa.int64()), "bundle": pa.array([out.finish()], pa.binary())})

    return materialize(marked.mapInArrow(bundle, "records long, bundle binary"), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """The records of a table of bundles, read through seek tables and indexes."""

    def unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["bundle"]:
                reader, rows = BundleReader(raw.as_py()), []
                for page, frame, offset, length in reader.index:
                    x = parse(reader.read(frame, offset, length))
                    digest = x["digest"] if x["payload"] is None else hashlib.sha1(x["payload"]).hexdigest()
                    rows.append((page, x["payload_bytes"] if x["payload"] is None else len(x["payload"]), digest, x["type"], x["refers_to"]))
                page, size, digest, kind, refers = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(page, pa.int64()), "payload_bytes": pa.array(size, pa.int64()), "payload_digest": pa.array(digest, pa.string()), "record_type": pa.array(kind, pa.string()), "refers_to": pa.array(refers, pa.int64())})

    return bundles.mapInArrow(unbundle, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM d
"""
