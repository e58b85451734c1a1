"""Lexical retrieval packing of token sequences.

Documents are encoded once and kept as a table of ids. Document frequencies of all terms
(token ids, so at most the vocabulary's size) are counted over the whole table. Documents are
then range-partitioned by a lexical signature, which brings like texts together and splits
groups of copies of any size, and each partition is worked through in shards of bounded size.
A shard is a BM25 inverted index: each seed document opens a window, the index returns its
unused neighbours, best first by all of the seed's terms, and they fill the window; the one that
does not fit is cut there and its rest stays unused. A document's full windows need no
neighbours. What is left over in the last window of a shard goes on to the next one. Documents
of other shards are not searched.

Defined results: a null text is the empty text and gives the end id alone; texts of any
length are packed whole, as pieces of up to ``window`` ids; repeated rows are packed each;
ties of scores go to the earlier document; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import tokens
from factorloom.llm.common import materialize, mix, small_batches

WINDOW, END_ID = 2048, 1
#: Characters that are encoded together, ids in a shard.
BLOCK_CHARS, SHARD_IDS = 8 << 20, 1 << 20
#: Ids of a partition.
PARTITION_IDS = 16 << 20
K1, B = 1.2, 0.75
#: A term in one of so many documents of a shard, or more, has a row of postings.
DENSE = 8
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _signature(ids: np.ndarray) -> int:
    """The least hash of two neighbouring ids: copies share it, near copies mostly."""
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64) if len(ids) > 1 else ids.astype(np.uint64)
    return int(mix(pairs).min() >> np.uint64(1))


def id_type(path: str) -> str:
    """How ids are kept: two bytes where the vocabulary allows it."""
    return "<u2" if len(tokens.pieces(path)) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_tokens, signature, ids (little-endian unsigned integers of
    ``id_type``, with the end id)."""
    kept = id_type(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(path)

        def block(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            ids = [np.append(x, END_ID).astype("<u4") for x in encoder.encode(texts)]
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([_signature(x) for x in ids], pa.int64()), pa.array([x.astype(kept).tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "signature", "ids"])

        doc_ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                doc_ids.append(i)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield block(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
        if doc_ids:
            yield block(doc_ids, texts)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, signature long, ids binary")


def document_frequencies(table: DataFrame, kept: str = "<u4") -> DataFrame:
    """term, documents: in how many rows each id occurs; counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b["ids"]:
                ids = np.frombuffer(x.as_buffer(), kept)
                if len(ids) and (top := int(ids.max())) >= len(total):
                    total = np.concatenate([total, np.zeros(top + 1 - len(total), np.int64)])
                total[ids] += 1  # once for each distinct id, as repeated places of one assignment do not add up
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total[terms], pa.int64())], ["term", "documents"])

    return table.select("ids").mapInArrow(count, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))


class Shard:
    """BM25 over the open ends of documents: doc_ids, ids and how far each is used. Postings of
    a term that is in many documents are a row with a place for each document, all others a list."""

    def __init__(self, docs: list[list], idf: np.ndarray, mean: float):
        self.docs = docs  # [doc_id, ids, start]
        self.ends = [d[1][d[2] :] for d in docs]
        lengths, n = np.fromiter(map(len, self.ends), np.int64, len(docs)), max(1, len(docs))
        terms = np.concatenate(self.ends).astype(np.int64) if docs else np.empty(0, np.int64)
        keys, tf = np.unique(terms * n + np.repeat(np.arange(len(docs)), lengths), return_counts=True)
        term, doc = keys // n, keys % n
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        many = np.bincount(term, minlength=len(idf)) >= n / DENSE
        self.asked = np.zeros(len(idf), bool)
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        rows = np.zeros((int(many.sum()), n))
        own = many[term]
        rows[self.row[term[own]], doc[own]] = weight[own]
        self.rows = list(rows)
        self.doc, self.weight = doc[~own], weight[~own]
        self.start = np.searchsorted(term[~own], np.arange(len(idf) + 1)).tolist()

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents by falling score; each of the seed's terms is a query term."""
        self.asked[self.ends[seed]] = True
        query = np.flatnonzero(self.asked)
        self.asked[query] = False
        row = self.row[query]
        scores = np.zeros(len(self.docs))
        for r in row[row >= 0].tolist():
            scores += self.rows[r]
        spans = [slice(self.start[t], self.start[t + 1]) for t in query[row < 0].tolist()]
        if spans:
            scores += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), scores.size)
        return np.argsort(-scores, kind="stable")  # those without a shared term come last


class Packer:
    """Hands out sequences and their pieces."""

    def __init__(self, first_sequence: int, window: int):
        self.sequence, self.window, self.rows = first_sequence, window, []

    def piece(self, doc: list, length: int, offset: int) -> None:
        ids = doc[1][doc[2] : doc[2] + length]
        self.rows.append((doc[0], doc[2], length, zlib.crc32(ids.tobytes()), len(doc[1]), self.sequence, offset))
        doc[2] += length

    def shard(self, docs: list[list], idf: np.ndarray, mean: float, last: bool) -> list[list]:
        """Pack a shard; returns the documents of an unfinished last window, unless this is
        the last shard."""
        for d in docs:
            while len(d[1]) - d[2] >= self.window:
                self.piece(d, self.window, 0)
                self.sequence += 1
        docs = [d for d in docs if d[2] < len(d[1])]
        index = Shard(docs, idf, mean)
        left = sum(len(d[1]) - d[2] for d in docs)
        for seed, d in enumerate(docs):
            if d[2] == len(d[1]):
                continue
            if left < self.window and not last:
                return [x for x in docs if x[2] < len(x[1])]
            n = min(len(d[1]) - d[2], self.window)
            self.piece(d, n, 0)
            at = n
            if at < self.window and left > n:
                for c in index.neighbours(seed):
                    rest = len(docs[c][1]) - docs[c][2]
                    if rest and at < self.window:
                        n = min(rest, self.window - at)
                        self.piece(docs[c], n, at)
                        at += n
                    if at == self.window:
                        break
            left -= at
            self.sequence += 1
        return []


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most ``window`` ids: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. A sequence is its pieces by offset."""
    small_batches(spark)
    path = path or tokens.vocabulary_path()
    kept = id_type(path)
    table = materialize(token_table(docs, path), "tokens")
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    counts = document_frequencies(table, kept).collect()  # a row for each id of the vocabulary at most
    found = np.zeros(max((r.term for r in counts), default=0) + 1)
    for r in counts:
        found[r.term] = r.documents
    idf = spark.sparkContext.broadcast(np.log1p((n - found + 0.5) / (found + 0.5)))
    mean = min(window, max(1.0, total / max(1, n)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_IDS))
    # Sorted, so that shards do not depend on the order in which rows arrive.
    dealt = table.repartitionByRange(parts, "signature", "doc_id").sortWithinPartitions("signature", "doc_id", F.xxhash64("ids"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, open_docs, size = Packer(TaskContext.get().partitionId() << 40, window), [], 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal open_docs
            open_docs = packer.shard(open_docs, idf.value, mean, last)
            rows, packer.rows = packer.rows, []
            cols = zip(*rows, strict=True) if rows else [[] for _ in range(7)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for i, x in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True):
                open_docs.append([i, np.frombuffer(x, kept).astype("<u4"), 0])
                size += len(open_docs[-1][1])
                if size >= SHARD_IDS:
                    yield flush(False)
                    size = 0
        yield flush(True)

    return dealt.select("doc_id", "ids").mapInArrow(fill, _PIECE)


def op4_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
