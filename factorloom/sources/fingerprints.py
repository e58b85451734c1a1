"""Fingerprints of files of any size: blocks are hashed where they are dealt, and block hashes are
joined into trees, so no value holds a file and no list holds all files.

Defined results: the fingerprint of a file of at most one block is its plain SHA-256, that of a larger
one the root of a tree over the SHA-256 of its blocks, so only files hashed with one block size
compare; empty files are not listed, as Spark's scans pass over them; a file that shrinks while it is read ends
the job; a path in both lists is UNCHANGED only if size and hash agree; no files give no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block, bytes read at once, children of a node.
BLOCK_BYTES, READ_BYTES, FANOUT = 64 << 20, 1 << 20, 256


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Spark path, which is not percent-encoded, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&,;~"))


def _block_hash(path: str, offset: int, size: int) -> str:
    system, name = _open(path)
    h, left = hashlib.sha256(), size
    with system.open_input_file(name) as f:
        f.seek(offset)
        while left:
            part = f.read(min(READ_BYTES, left))
            if not part:
                raise OSError(f"{path} ends before byte {offset + size}")
            h.update(part)
            left -= len(part)
    return h.hexdigest()


def file_blocks(spark: SparkSession, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, size_bytes, block, sha256: a row for each block of the files; only their paths and
    lengths are listed, and each block is a range of its own for whichever task gets it."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0))
    blocks = files.select("path", F.col("length").alias("size_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block")).repartition("path", "block")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b["path"].to_pylist(), b["size_bytes"].to_pylist(), b["block"].to_pylist(), strict=True)
            out = [_block_hash(path, k * block_bytes, min(block_bytes, size - k * block_bytes)) for path, size, k in rows]
            yield pa.RecordBatch.from_arrays([b["path"], b["size_bytes"], b["block"], pa.array(out, pa.string())], ["path", "size_bytes", "block", "sha256"])

    return blocks.mapInArrow(hashed, "path string, size_bytes long, block long, sha256 string")


def _level(nodes: DataFrame, key: list[str], node: str, fanout: int) -> DataFrame:
    """Parents of nodes: the hash of up to fanout children's hashes in order."""
    children = F.array_sort(F.collect_list(F.struct(F.col(node), F.col("sha256"))))
    joined = F.sha2(F.array_join(F.transform(children, lambda c: c["sha256"]), ""), 256)
    return nodes.groupBy(*key, F.floor(F.col(node) / fanout).alias(node)).agg(F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(joined).alias("sha256"))


def file_hashes(spark: SparkSession, pattern: str, block_bytes: int = BLOCK_BYTES, fanout: int = FANOUT, largest: int = 1 << 50) -> DataFrame:
    """path, size_bytes and sha256 of each file; levels enough for files of ``largest`` bytes. A node
    with one child passes its hash on, so further levels change nothing."""
    nodes, blocks = file_blocks(spark, pattern, block_bytes), -(-largest // block_bytes)
    while blocks > 1:
        nodes, blocks = _level(nodes, ["path", "size_bytes"], "block", fanout), -(-blocks // fanout)
    return nodes.select("path", "size_bytes", "sha256")


def tree_hash(files: DataFrame) -> DataFrame:
    """One hash over all (path, sha256), whatever their order: 4096 groups by the path's hash, then
    their hashes in order. A group holds a 4096th of the list."""
    own = files.select(F.substr(F.sha2("path", 256), F.lit(1), F.lit(3)).alias("group"), F.concat_ws(":", "path", "sha256").alias("entry"))
    groups = own.groupBy("group").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("files"))
    nodes = F.array_sort(F.collect_list(F.concat_ws(":", "group", "sha256")))
    return groups.agg(F.sha2(F.array_join(nodes, "\n"), 256).alias("tree_sha256"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def compare_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each path: before and after are lists of (path, size_bytes, sha256)."""
    a = before.select("path", F.col("size_bytes").alias("size_before"), F.col("sha256").alias("sha256_before"))
    b = after.select("path", F.col("size_bytes").alias("size_after"), F.col("sha256").alias("sha256_after"))
    same = (F.col("size_before") == F.col("size_after")) & (F.col("sha256_before") == F.col("sha256_after"))
    status = F.when(F.col("sha256_before").isNull(), "ADDED").when(F.col("sha256_after").isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("CHANGED")
    return a.join(b, "path", "full").withColumn("status", status)


def protected_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files before and after, how many of each status, and PASS if none was touched."""
    rows = compare_files(before, after)
    count = lambda s: F.count_if(F.col("status") == s)
    out = rows.agg(F.count("sha256_before").alias("files_before"), F.count("sha256_after").alias("files_after"), *(count(s).alias(s.lower()) for s in ("UNCHANGED", "CHANGED", "ADDED", "REMOVED")))
    return out.withColumn("status", F.when(F.col("unchanged") == F.greatest("files_before", "files_after"), "PASS").otherwise("FAIL"))


def dataset_files(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """For each dataset: files, their bytes, rows, dates and the latest change, in one pass over the
    scan, whose hidden columns name each row's file. PASS if it has rows. Files without rows
    have no row to be named by."""
    parts = []
    for name, (df, day) in tables.items():
        date = F.col(day).cast("date") if day else F.lit(None).cast("date")
        rows = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time", date.alias("day"))
        by_file = rows.groupBy("file_path").agg(F.max("file_size").alias("size"), F.max("file_modification_time").alias("changed"), F.count(F.lit(1)).alias("n"), F.min("day").alias("low"), F.max("day").alias("high"))
        one = by_file.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.min("low").alias("minimum_date"), F.max("high").alias("maximum_date"), F.max("changed").alias("last_changed"))
        parts.append(one.select(F.lit(name).alias("dataset"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL"))
