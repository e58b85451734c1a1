"""Toxicity by compression distance: how much shorter do windows of a text become with a
zstandard dictionary of toxic text than without it.

1. Of a bounded sample of labelled documents one half trains two dictionaries with zstandard's
   own trainer: one on windows of toxic texts, one on windows of ordinary ones.
2. The toxic dictionary also holds what toxic texts share with all others. On the other half of
   the sample each of its runs of ``GRAM`` bytes is counted in toxic and in ordinary documents;
   only runs that occur clearly more often in toxic ones stay in it.
3. A window is ``WINDOW_WORDS`` consecutive words of the text, with each byte moved on by its
   place in its word, so that only equal beginnings of words match. It is compressed with the ordinary
   dictionary and with the toxic one before the same ordinary one, so that ordinary passages
   cost the same and the difference is what toxic content saves.
4. How many windows save how many bytes goes through thresholds calibrated on the second half
   (boosted trees that may only rise with any saving).

Defined results: a null or empty text has no windows and gets the score of no saving; texts of
any length are scored whole; repeated rows get the same score, and of labelled rows with one
doc_id any one text is learned from, with the greatest label; scores have no ties to break;
without usable labels all scores are one constant; an empty table gives an empty result; labels,
language, source and id are never inputs of a score; other columns are ignored by the scores and
kept by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import boosting
from factorloom.llm.common import as_bytes, small_batches, table

#: Bounds of the sample: labelled documents (the least by hashed id), characters of one, and
#: windows of ordinary text for the trainer.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS, MAX_WINDOWS = 8_000, 20_000, 60_000
#: A document with a score from here on counts as toxic.
TOXIC_FROM = 0.3
WINDOW_WORDS, LEVEL = 8, 6
#: Odd, so that all places up to 255 move a byte differently.
SHIFT = 37
#: Sizes of the trained dictionaries, the trainer's segments, and the shortest match.
ORDINARY_BYTES, TOXIC_BYTES, GRAM = 8192, 8192, 5
_TRAINER = {"ordinary": {"d": 6, "k": 32}, "toxic": {"d": 6, "k": 16}}
#: A run of the toxic dictionary stays if it is in this share of toxic documents at least, and
#: this many times as often as in ordinary ones.
MIN_SHARE, MIN_RATIO = 0.03, 6
#: Bytes saved from which windows are counted.
SAVED = (1, 2, 3, 4, 5, 6, 7, 9)


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def windows(text: bytes, every: int = 1, first: int = 0) -> list[bytes]:
    """Consecutive windows of a text, or every n-th of them from the given one on: words in
    lower case, each behind a space, its bytes moved on by ``SHIFT`` times their place."""
    raw = np.frombuffer(text.lower(), np.uint8)
    kept = ~_SPACE[raw]
    starts = np.flatnonzero(kept & np.concatenate([[True], ~kept[:-1]])) if len(raw) else np.empty(0, np.int64)
    at = np.flatnonzero(kept)
    word = np.searchsorted(starts, at, "right") - 1
    out = np.full(len(at) + len(starts) + 1, 0x20, np.uint8)
    out[np.arange(len(at)) + word + 1] = raw[at] + (SHIFT * (at - starts[word])).astype(np.uint8)
    begins = np.searchsorted(at, starts) + np.arange(len(starts))
    line, size = out.tobytes(), len(out)
    cuts = [*begins[::WINDOW_WORDS].tolist(), size - 1]
    return [line[cuts[i] : cuts[i + 1] + 1] for i in range(first, len(cuts) - 1, every)]


def _grams(content: bytes) -> np.ndarray:
    """All runs of GRAM bytes, as numbers."""
    v = np.frombuffer(content, np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(v) - GRAM + 1), np.int64)
    for i in range(GRAM if len(out) else 0):
        out = out << 8 | v[i : i + len(out)]
    return out


def trained(samples: list[bytes], size: int, kind: str) -> bytes:
    """A dictionary by zstandard's trainer; of too few samples, their end."""
    try:
        return zstandard.train_dictionary(size, samples, **_TRAINER[kind]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def typical_part(dictionary: bytes, toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The runs of a dictionary that clearly more of the toxic texts contain."""
    grams = _grams(dictionary)
    known = np.unique(grams)

    def documents(texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(known), np.int64)
        for t in texts:
            own = np.unique(np.concatenate([np.empty(0, np.int64), *map(_grams, windows(t))]))
            out += np.isin(known, own, assume_unique=True)
        return out

    a, b = documents(toxic), documents(ordinary)
    typical = ((a + 0.5) / (len(toxic) + 1) > MIN_RATIO * (b + 0.5) / (len(ordinary) + 1)) & (a >= max(2, MIN_SHARE * len(toxic)))
    stays = np.zeros(len(dictionary), bool)
    starts = np.flatnonzero(typical[np.searchsorted(known, grams)]) if len(grams) else np.empty(0, np.int64)
    for i in range(GRAM):
        stays[starts + i] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], stays.astype(np.int8), [0]])))
    return b" ".join(dictionary[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    trees: boosting.Trees | None

    def meter(self) -> Meter:
        return Meter(self.toxic, self.ordinary)


class Meter:
    """Compresses windows with both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=GRAM, strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.by_ordinary, self.by_toxic = (self._compress(x, plain) for x in (ordinary, toxic + ordinary))

    @staticmethod
    def _compress(content: bytes, plain):
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=plain).compress
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=plain).compress

    def savings(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window of a text."""
        own = windows(text)
        return np.fromiter((len(self.by_ordinary(w)) - len(self.by_toxic(w)) for w in own), np.int64, len(own))

    def features(self, text: bytes) -> list[float]:
        saved = self.savings(text)
        counts = [int((saved >= s).sum()) for s in SAVED]
        return [*counts, *(100 * c / (20 + len(saved)) for c in counts), int(saved.max(initial=0)), len(saved)]


_MONOTONE = [1] * (2 * len(SAVED) + 1) + [0]


def train_toxicity(texts: list[bytes], toxic: np.ndarray) -> ToxicityModel:
    """The dictionaries and thresholds of texts labelled toxic (1) or not (0). Of each label
    every other text trains the dictionaries, the rest choose and calibrate."""
    rank = np.where(toxic == 1, np.cumsum(toxic == 1), np.cumsum(toxic != 1))
    pick = lambda half, label: [texts[i] for i in np.flatnonzero((rank % 2 == half) & (toxic == label))]
    plain = pick(1, 0)
    every = max(1, sum(map(len, plain)) // (7 * WINDOW_WORDS * MAX_WINDOWS))
    ordinary = trained([w for i, t in enumerate(plain) for w in windows(t, every, i % every)], ORDINARY_BYTES, "ordinary")
    found = trained([w for t in pick(1, 1) for w in windows(t)], TOXIC_BYTES, "toxic")
    model = ToxicityModel(typical_part(found, pick(0, 1), pick(0, 0)), ordinary, None)
    meter, rest = model.meter(), np.flatnonzero(rank % 2 == 0)
    x = np.array([meter.features(texts[i]) for i in rest], float).reshape(-1, len(_MONOTONE))
    model.trees = boosting.train(x, toxic[rest].astype(float), _MONOTONE, rounds=60, depth=3, rate=0.1)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_train_rows: int = MAX_TRAIN_ROWS, max_train_chars: int = MAX_TRAIN_CHARS) -> ToxicityModel:
    """Train on a bounded sample of labels(doc_id, toxic) joined with docs; ``learn`` says of
    which doc_id labels may be learned."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)")
    if learn is not None:
        usable = usable.where(learn)
    short = docs.select("doc_id", "text").where(F.length("text") <= max_train_chars)
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(short.select("doc_id"), "doc_id", "left_semi")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    texts = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(texts.toLocalIterator(), key=lambda r: r.doc_id)
    return train_toxicity([r.text.encode() for r in rows], np.array([r.toxic for r in rows], int))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of docs(doc_id, text); one scan without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = sent.value.meter()
        for b in batches:
            x = np.array([meter.features(t) for t in as_bytes(b["text"])], float).reshape(-1, len(_MONOTONE))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sent.value.trees.predict(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: ToxicityModel, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of docs, with all their columns, that score below ``toxic_from``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = sent.value.meter()
        for b in batches:
            x = np.array([meter.features(t) for t in as_bytes(b["text"])], float).reshape(-1, len(_MONOTONE))
            yield b.filter(pa.array(sent.value.trees.predict(x) < toxic_from))

    return docs.mapInArrow(keep, docs.schema)


def held_out() -> Column:
    """Whether labels of a doc_id are kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
