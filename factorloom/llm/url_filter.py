"""URL filter rules as a sorted digest array.

The rule keys (host and path prefix, such as ``example.net/en/``) are hashed with 64-bit
xxhash and stored sorted, with the full strings behind them, in one file that each worker
maps into memory. A url is probed with every suffix of its host joined with every prefix of
its path of a length that some rule has; the probes are found by vectorised binary search and
confirmed against the stored strings, so that a collision of digests never decides.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed; repeated rows are judged alike; an empty table gives an empty result; other
columns of the input are ignored. Of several fitting rules the longest key wins. Urls of any length
are judged whole.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import as_bytes, small_batches

#: The index is broadcast; a rule list beyond this size raises an error.
MAX_INDEX_BYTES = 512 << 20

#: Fixed values of the query: verdict, host, path prefix.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class DigestIndex:
    """Sorted digests, string offsets and strings in one buffer."""

    def __init__(self, buffer: np.ndarray):
        n, p = (int(x) for x in buffer[:16].view(np.uint64))
        at = 16
        self.path_lengths = buffer[at : at + 8 * p].view(np.uint64).astype(np.int64)
        at += 8 * p
        self.digests = buffer[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = buffer[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.verdicts = buffer[at : at + n]
        self.strings = buffer[at + n :]

    @staticmethod
    def build(rules: list[tuple[str, str, str]]) -> bytes:
        """rules: verdict (allow or block), host, path prefix. The later of equal keys is dropped."""
        keys: dict[bytes, int] = {}
        lengths = set()
        for verdict, host, path in rules:
            keys.setdefault(host.translate(str.maketrans(_UPPER, _LOWER)).encode() + path.encode(), int(verdict == "block"))
            lengths.add(len(path.encode()))
        order = sorted((xxhash.xxh64_intdigest(k), k) for k in keys)
        parts = [
            np.array([len(order), len(lengths)], np.uint64),
            np.array(sorted(lengths), np.uint64),
            np.array([d for d, _ in order], np.uint64),
            np.cumsum([0, *(len(k) for _, k in order)]).astype(np.uint64),
            np.array([keys[k] for _, k in order], np.uint8),
        ]
        out = b"".join(x.tobytes() for x in parts) + b"".join(k for _, k in order)
        if len(out) > MAX_INDEX_BYTES:
            raise ValueError(f"the rule index takes {len(out)} bytes; at most {MAX_INDEX_BYTES} are broadcast")
        return out

    @staticmethod
    def mapped(blob: bytes) -> DigestIndex:
        """The index in a file of this worker that is mapped into memory."""
        with tempfile.NamedTemporaryFile(delete=False) as f:
            f.write(blob)
        index = DigestIndex(np.memmap(f.name, np.uint8, "r"))
        os.unlink(f.name)  # the mapping keeps it
        return index

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the place of the rule with exactly this key, or -1."""
        if not len(self.digests):
            return np.full(len(keys), -1)
        probes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, probes, "left")
        last = np.searchsorted(self.digests, probes, "right")
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(first < last):
            for at in range(first[i], last[i]):  # more than one only if digests collide
                if self.string(at) == keys[i]:
                    out[i] = at
        return out

    def string(self, at: int) -> bytes:
        return self.strings[int(self.offsets[at]) : int(self.offsets[at + 1])].tobytes()

    def longest(self, hosts: list[bytes], paths: list[bytes]) -> list[int]:
        """For each url the place of its longest rule, or -1."""
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            labels = host.split(b".")
            for a in range(len(labels)):
                suffix = b".".join(labels[a:])
                for n in self.path_lengths:
                    if n <= len(path):
                        keys.append(suffix + path[:n])
                        owner.append(i)
        best, size = [-1] * len(hosts), [-1] * len(hosts)
        for j, at in enumerate(self.find(keys)):
            if at >= 0 and len(keys[j]) > size[owner[j]]:
                best[owner[j]], size[owner[j]] = int(at), len(keys[j])
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url column; both empty where it has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Judge pages(page_id, url): host, path, the longest fitting rule and its verdict; urls that
    no rule fits are allowed. One scan without a shuffle."""
    small_batches(spark)
    blob = spark.sparkContext.broadcast(DigestIndex.build(rules))
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex.mapped(blob.value)
        for b in batches:
            best = index.longest(as_bytes(b["host"]), as_bytes(b["path"]))
            rule = [index.string(i).decode() if i >= 0 else None for i in best]
            verdict = ["block" if i >= 0 and index.verdicts[i] else "allow" for i in best]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = """
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM parts JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
"""
