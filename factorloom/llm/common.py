"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the separators of the word pattern ``[^\x20\x09-\x0D]+``;
#: ``bytes.split()`` without arguments splits at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: keeps a batch of long documents within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes for the Python stages
    of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session. Only where it is unset (tests, local mode) a
    temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: With it, a finished query's shuffle files are removed at once.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage and
    survives the loss of executors. The shuffle files of the write are removed after it."""
    spark = df.sparkSession
    path, before = shared_dir(spark, purpose), spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: Bytes of input for which there is one bucket at least.
BUCKET_BYTES = 32 << 20


def n_buckets(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Buckets that packed keys are dealt to: follows the session's shuffle partitions and the
    size of the input."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (input_bytes(df) if df is not None else 0) // BUCKET_BYTES)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by the planner's statistics; others count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # more stands for an unknown size


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8; null becomes b''."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: for each its dtype, length and bytes."""
    head = b"".join(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") for a in arrays)
    raw = len(arrays).to_bytes(2, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:2], "little"), 2, []
    heads = [(raw[at + 12 * i : at + 12 * i + 4].decode().strip(), int.from_bytes(raw[at + 12 * i + 4 : at + 12 * i + 12], "little")) for i in range(n)]
    at += 12 * n
    for kind, size in heads:
        dtype = np.dtype(kind)
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once for each distinct word; emptied when it
    holds ``most`` words so that a task's memory stays bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k consecutive word hashes (polynomial, then mixed)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + words[i : i + n]) * _MIX
    return mix(h)
