"""BPE encoding through a table of distinct words, and decoding through a join with the pieces.

Encoding shuffles packed rows only:

1. each task cuts its texts into words, block by block; a block sends its distinct words,
   packed, to buckets by the word's hash;
2. a bucket puts the words of all blocks into one table, encodes each distinct word once and
   sends every block the ids of its words;
3. a second scan sends the coded texts of each block, and the block joins the ids back by
   position. Coding twice costs less than carrying the coded texts through both shuffles.

A block is named by a digest of its coded texts; equal blocks are placed once and given out as
often as they occur. An input whose rows arrive in another order
in the second scan (one that is neither a table nor checkpointed) is an error, never a wrong
result.

A hot word is one entry of each block, however often it occurs, so no task gets more than
its share. Decoding joins ids with the table of pieces (its size is the vocabulary's).

Defined results: a null text is the empty text and has no ids; repeated rows are encoded
alike; texts of any length are encoded whole; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import tokens
from factorloom.llm.common import input_bytes, n_buckets, pack, small_batches, unpack

#: Characters of text in a block, and blocks whose equal words are encoded once; as common words
#: are in every block, a task's words would grow with the corpus without this bound.
BLOCK_CHARS, GROUP_BLOCKS = 8 << 20, 256
#: Characters that a byte of input may stand for, as tables are compressed.
EXPANSION = 4
#: Words of a block that are expanded to ids at once.
STEP = 1 << 19
_ROW = "key long, block long, bucket int, payload binary"


def _join_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    return np.fromiter(map(len, raw), np.uint32, len(raw)), np.frombuffer(b"".join(raw), np.uint8)


def _word_array(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _block_rows(ids: list, texts: list[str], buckets: int, groups: int, with_words: bool) -> pa.RecordBatch:
    """A row for each bucket with the words of a block, or one row with its coded texts."""
    words, codes, counts = tokens.code_texts(texts)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")] = np.arange(len(words))
    words = [w for _, w in sorted(zip(rank, words, strict=True))]  # frequent first: small codes
    codes = rank[codes]
    bucket = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
    planes = [((codes >> s) & 255).astype(np.uint8) for s in (0, 8, 16, 24)]  # bytes of alike meaning together
    known = np.array([x is not None for x in ids])
    docs = pack(known, np.array([x or 0 for x in ids], np.int64), counts, bucket, *planes)
    block = xxhash.xxh64_intdigest(docs) >> 1
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets), "right") if with_words else []
    rows = [] if with_words and len(words) else [(block, block, -1, docs)]
    for b, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True) if len(ends) else ()):
        if start < end:
            rows.append((b + buckets * (block % groups), block, b, pack(*_join_words([words[i] for i in order[start:end]]))))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "block", "bucket", "payload"])


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of each text of docs(doc_id, text), as little-endian unsigned 32-bit integers:
    doc_id, n_tokens long, ids binary."""
    small_batches(spark)
    path, buckets = path or tokens.vocabulary_path(), n_buckets(spark)
    groups = 1 + EXPANSION * input_bytes(docs) // (BLOCK_CHARS * GROUP_BLOCKS)

    def cut(batches: Iterator[pa.RecordBatch], with_words: bool) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield _block_rows(ids, texts, buckets, groups, with_words)
                    ids, texts, size = [], [], 0
        if ids:
            yield _block_rows(ids, texts, buckets, groups, with_words)

    def encode(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.unique(rows["block"].to_numpy(), return_index=True)[1])  # equal blocks get one answer
        lists = [unpack(x.as_py()) for x in rows["payload"]]
        table = pa.chunked_array([_word_array(*x) for x in lists]).combine_chunks().dictionary_encode()
        lengths, ids = tokens.encode_words([w.decode() for w in table.dictionary.to_pylist()], path)
        starts = np.cumsum(lengths) - lengths
        codes, at, out = table.indices.to_numpy(), 0, []
        for x in lists:
            own = codes[at : at + len(x[0])]
            at += len(own)
            flat = ids[tokens.spread(lengths, starts, own)]
            out.append(pack(lengths[own].astype(np.uint16) if lengths.max() < 65536 else lengths[own], flat.astype(np.uint16) if flat.max(initial=0) < 65536 else flat))
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "payload": pa.array(out, pa.binary())})

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        copies = int((rows["bucket"].to_numpy() == -1).sum())  # the coded rows come first
        known, doc_ids, counts, bucket, *planes = unpack(rows["payload"][0].as_py())
        if not copies or len(rows["payload"][:copies].unique()) > 1 or len(rows) - copies != len(np.unique(bucket)):
            raise RuntimeError("the rows of a block differ between two runs of its task; checkpoint the input")
        parts = [unpack(x.as_py()) for x in rows["payload"][copies:]]
        order = np.argsort(bucket, kind="stable")
        lengths = np.empty(len(bucket), np.int64)
        lengths[order] = np.concatenate([*(p[0] for p in parts), np.empty(0, np.int64)])
        starts = np.empty(len(bucket), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        ids = np.concatenate([*(p[1] for p in parts), np.empty(0, np.uint16)])
        out, n, codes = [], [], planes[0].astype(np.int32) | planes[1].astype(np.int32) << 8 | planes[2].astype(np.int32) << 16 | planes[3].astype(np.int32) << 24
        bounds = np.concatenate([[0], np.cumsum(counts)])
        first = 0
        while first < len(counts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STEP, "right")) - 1)
            own = codes[bounds[first] : bounds[last]]
            flat = ids[tokens.spread(lengths, starts, own)].astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(lengths[own])])[bounds[first : last + 1] - bounds[first]]
            out += [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            n += np.diff(cuts).tolist()
            first = last
        return pa.concat_tables([pa.table({"doc_id": pa.array(doc_ids, pa.int64(), mask=~known), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(out, pa.binary())})] * copies)

    texts = docs.select("doc_id", "text")
    words = texts.mapInArrow(partial(cut, with_words=True), _ROW).where("bucket >= 0")
    coded = texts.mapInArrow(partial(cut, with_words=False), _ROW).select("block", "bucket", "payload")
    encoded = words.groupBy("key").applyInArrow(encode, "block long, bucket int, payload binary")
    return encoded.unionByName(coded).groupBy("block").applyInArrow(place, "doc_id long, n_tokens long, ids binary")


def decode_documents(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, n_tokens, ids binary) with the column text: each id is joined with the
    table of pieces by its place there and the pieces of a document are joined in order; bytes
    that are not UTF-8 become U+FFFD."""
    small_batches(spark)
    path = path or tokens.vocabulary_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(tokens.pieces(path), pa.large_binary())
        for b in batches:
            ids = np.frombuffer(b"".join(b["ids"].to_pylist()), "<u4")
            joined = table.take(pa.array(ids))
            offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
            cuts = offsets[np.concatenate([[0], np.cumsum(b["n_tokens"].to_numpy())])]
            data = joined.buffers()[2].to_pybytes() if len(ids) else b""
            text = [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "text"])

    return encoded.mapInArrow(decode, "doc_id long, n_tokens long, ids binary, text string")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decode_documents(spark, encoded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
