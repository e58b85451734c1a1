"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches without a shuffle. The trees are
trained on statistics of at most ``max_train_rows`` labelled documents, flattened into numpy
arrays, broadcast and applied batch by batch. They may only get stricter with more symbols,
repeats, duplicate lines or capitals.

Defined results: a null or empty text has no words and fails the base rules; repeated rows
get the same verdict; without usable labels every document that passes the base rules is
kept; an empty table gives an empty result; other columns of the input are ignored by the
statistics and kept by the filter, whatever their names. Texts of any length are measured whole;
there are no ties, as each document is judged by itself; of labels with one doc_id the greatest
counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import boosting
from factorloom.llm.common import as_bytes, small_batches, table

#: Labelled documents that the trees are fitted on, at most; the least by hashed id.
MAX_TRAIN_ROWS = 20_000
#: Documents whose probability of good quality is lower are rejected.
KEEP_FROM = 0.5

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(97, 123))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees see, and the direction in which each may act on the probability of keeping.
FEATURES = {"n_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "mark_share": -1, "most_frequent_share": -1, "distinct_share": 0}
_STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"f_{f} double" for f in FEATURES)


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and lines with a word."""
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return dup, lines


def _repeat_words(codes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(codes) < 3:
        return 0
    n = int(codes.max()) + 1
    pair = np.unique(codes[:-1].astype(np.int64) * n + codes[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1].astype(np.int64) * n + codes[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def statistics(text: bytes) -> list[float]:
    """The base statistics, then the features, of one text in UTF-8."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUED))
    symbols = len(_SYMBOLS.findall(text))
    dup, lines = _dup_lines(text)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeat = _repeat_words(codes)
    upper = len(joined) - len(joined.translate(None, _UPPER))
    letters = upper + len(joined) - len(joined.translate(None, _LOWER))
    most = int(np.bincount(codes).max()) if n else 0
    k = max(n, 1)
    return [n, chars, symbols, dup, repeat, n, chars / k, symbols / k, dup / max(lines, 1), repeat / k, upper / max(letters, 1), text.count(b"!") / k, most / k, len(known) / k]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics and the features f_* of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *BASE, *(f"f_{f}" for f in FEATURES)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(x) for x in as_bytes(b["text"])], float).reshape(-1, len(names) - 1)
            base = [pa.array(rows[:, i].astype(np.int64)) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *base, *(pa.array(rows[:, i]) for i in range(len(BASE), rows.shape[1]))], names)

    return docs.select("doc_id", "text").mapInArrow(measure, _STATS)


def train_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> boosting.Trees:
    """Trees fitted to labels(doc_id, quality) of docs. Only ids and labels of the bounded sample
    are broadcast, and only statistics of its documents come to the driver."""
    sample = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = document_statistics(texts).join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    x = rows[[f"f_{f}" for f in FEATURES]].to_numpy(float)
    return boosting.train(x, rows["quality"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text) as doc_id, base statistics, base_failed, quality_score and kept."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train_quality(docs, labels, max_train_rows))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b[f"f_{f}"].to_numpy(zero_copy_only=False) for f in FEATURES], 1) if len(b) else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(b[c] for c in BASE), pa.array(model.value.predict(x))], ["doc_id", *BASE, "quality_score"])

    scored = document_statistics(docs).mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_score double")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= KEEP_FROM))


def keep_good(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that ``judge`` keeps; one scan without a shuffle."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, max_train_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in as_bytes(b["text"])], float).reshape(-1, len(BASE) + len(FEATURES))
            good = (x[:, 0] >= 50) & (100 * x[:, 4] <= 50 * x[:, 0]) & (model.value.predict(x[:, len(BASE) :]) >= KEEP_FROM)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
