"""Documents in ISO media containers: written as boxes, found again through sample tables.

A payload is stored unchanged as samples of 576 bytes in a ``mdat`` box; ``moov`` holds the
track: codec (``stsd``), timing (``stts``), chunks (``stsc``, ``co64``), sizes (``stsz``) and
key samples (``stss``). The reader knows none of this beforehand: it walks the nested boxes,
decodes the sample tables and returns codec, duration and the byte ranges of samples and
keyframes; no payload byte is interpreted.

Defined results: a null text is the empty text, stored as one sample of bytes 255; texts of
any length are stored whole; equal texts give equal containers; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factorloom.llm.common import as_bytes, small_batches

SAMPLE, CHUNK_SAMPLES, KEY_EVERY, TIMESCALE, TICKS, CODEC = 576, 16, 8, 8000, 576, b"raw "
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)
    return struct.pack(">I4s", size, kind) + b"".join(body)


def _full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), body)


def pad(data: bytes, unit: int = SAMPLE) -> bytes:
    """The data with bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def write_container(payload: bytes) -> bytes:
    """A media file that holds the payload (a positive multiple of SAMPLE bytes)."""
    samples = len(payload) // SAMPLE
    duration = samples * TICKS
    chunks, rest = divmod(samples, CHUNK_SAMPLES)
    runs = ([(1, CHUNK_SAMPLES)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    entry = _box(CODEC, struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    keys = np.arange(1, samples + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    n_chunks = chunks + bool(rest)

    def moov(first: int) -> bytes:
        offsets = first + np.arange(n_chunks, dtype=np.int64) * (CHUNK_SAMPLES * SAMPLE)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1) + entry),
            _full(b"stts", struct.pack(">III", 1, samples, TICKS)),
            _full(b"stss", struct.pack(">I", len(keys)) + keys.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", a, n, 1) for a, n in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, samples)),
            _full(b"co64", struct.pack(">I", n_chunks) + offsets.astype(">u8").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), 1), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun") + b"samples\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0) + _MATRIX + bytes(8), 1, 3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, duration, 0x10000, 0x100) + _MATRIX + bytes(24) + struct.pack(">I", 2), 1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + _box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """Path, start and end of the body of every box, nested ones included."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} exceeds its parent")
        here = path + b"/" + kind
        yield here, body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, here)
        start += size


def read_tracks(media: bytes) -> list[dict]:
    """Codec, duration in seconds, and byte ranges (offset, size arrays) of samples and
    keyframes of each track."""
    data, tracks = memoryview(media), []
    for path, a, b in walk(data):
        kind = path[-4:]
        if kind == b"trak":
            tracks.append({})
        if not tracks or not path.startswith(b"/moov/trak"):
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["scale"], t["ticks"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
        elif kind == b"stts":
            t["stts"] = np.frombuffer(data[a + 8 : b], ">u4").reshape(-1, 2).astype(np.int64)
        elif kind == b"stss":
            t["stss"] = np.frombuffer(data[a + 8 : b], ">u4").astype(np.int64)
        elif kind == b"stsc":
            t["stsc"] = np.frombuffer(data[a + 8 : b], ">u4").reshape(-1, 3).astype(np.int64)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            t["stsz"] = np.full(n, size, np.int64) if size else np.frombuffer(data[a + 12 : b], ">u4").astype(np.int64)
        elif kind in (b"co64", b"stco"):
            t["chunks"] = np.frombuffer(data[a + 8 : b], ">u8" if kind == b"co64" else ">u4").astype(np.int64)
    for t in tracks:
        first, per = t["stsc"][:, 0], t["stsc"][:, 1]
        in_chunk = np.repeat(per, np.diff(np.append(first, len(t["chunks"]) + 1)))
        sizes, chunk = t["stsz"], np.repeat(np.arange(len(t["chunks"])), in_chunk)
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first_of_chunk = np.concatenate([[0], np.cumsum(in_chunk)[:-1]])
        offsets = t["chunks"][chunk] + before - before[first_of_chunk][chunk]
        keys = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
        t |= {"offsets": offsets, "sizes": sizes, "key_offsets": offsets[keys], "key_sizes": sizes[keys], "seconds": int((t["stts"][:, 0] * t["stts"][:, 1]).sum()) / t["scale"]}
    return tracks


def read_payload(media: bytes, track: dict) -> bytes:
    """The track's samples in order; adjacent ranges are read as one."""
    offsets, ends = track["offsets"], track["offsets"] + track["sizes"]
    cut = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(offsets)]])
    return b"".join(media[offsets[i] : ends[j - 1]] for i, j in zip(starts, stops, strict=True))


def feature(track: dict) -> str:
    """Codec, duration, sample counts and keyframe byte ranges (count, first, last and digest)."""
    keys = np.stack([track["key_offsets"], track["key_sizes"]], 1).astype("<i8")
    return json.dumps(
        {"codec": track["codec"], "seconds": round(track["seconds"], 6), "samples": len(track["sizes"]), "keyframes": len(keys), "first_key": keys[0].tolist(), "last_key": keys[-1].tolist(), "key_ranges_crc32": zlib.crc32(keys.tobytes())}
    )


def store_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with its media file (binary) and the length of the text in bytes."""
    small_batches(spark)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) for x in texts], pa.int64()), pa.array([write_container(pad(x)) for x in texts], pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def index_media(media: DataFrame) -> DataFrame:
    """What the containers of media(doc_id, n_bytes, media) say, and digests of what they hold."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b["media"]:
                blob = raw.as_py()
                track = read_tracks(blob)[0]
                payload = read_payload(blob, track)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(track), track["key_offsets"].tolist(), track["key_sizes"].tolist()))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "key_offsets", "key_sizes"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, key_offsets array<long>, key_sizes array<long>"
    return media.mapInArrow(index, schema)


def op3_media_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media files are handed from the writing to the reading stage within each task."""
    return index_media(store_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("key_offsets", "key_sizes")
