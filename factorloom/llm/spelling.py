"""Spelling variants by permuterm rotations: words that differ by one code point, the commoner form
of each, and the root that the forms lead to.

1. Tasks count runs of letters; in one of 97 runs, chosen by a checksum of document and run, one
   letter is missing. The checksum of a run behind any prefix follows from the checksums of both,
   so runs are looked up in a table of words and hashed once, not once for each document.
2. Words get ids in code-point order, so later steps carry ids instead of words and ties are
   ordered by id.
3. Each word is marked with a terminator and rotated. A rotation without its last letter is the
   prefix that it shares with all words which differ in this letter, and it is the whole
   rotation of a word without the letter. So a word of L letters has L prefixes and L + 1 whole
   rotations; sorted, equal ones stand side by side. A letter that equals the one before it gives
   the same shorter word again and is not counted for it.
4. A scan over each run of equal keys gives every member its number of neighbours and the best
   other member. A key holds at most one word for each letter of the alphabet and one shorter word,
   so no pairs are made; the results of a word's keys are added up.
5. Roots follow the forms by pointer jumping. As a form is at least twice as frequent, chains are
   short.

Defined results: null and empty texts have no words; rows without doc_id are counted as they are,
without missing letters; texts and runs of any length are taken whole (keys beyond ``TEXT_KEY``
letters are replaced by 124-bit polynomial digests, so a long run costs memory by its length, not
by its square); of forms with equal counts the least in code-point order is taken; repeated
rows count again; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import as_bytes, discard, materialize, small_batches, table

#: Shortest word, least occurrences, the divisor that picks runs, and how much commoner a form is.
MIN_LETTERS, MIN_COUNT, PICK, TIMES = 5, 3, 97, 2
#: Longest key kept as text; bytes of a run up to which checksums are shifted by table.
TEXT_KEY, SHORT_RUN = 64, 64
#: Words and bytes of words that a task holds before it passes its counts on.
HELD_WORDS, HELD_BYTES, HELD_RUNS = 300_000, 16 << 20, 1 << 20

_RUNS = re.compile(f"[a-zÀ-ÿ]{{{MIN_LETTERS},}}")


def _crc_step() -> np.ndarray:
    """What one more zero byte does to a checksum, by its last byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _crc_step()


def shifted(crcs: np.ndarray, most: int) -> np.ndarray:
    """[k, i]: what checksum i becomes in front of k more bytes; xor with their own checksum
    gives the checksum of both."""
    out = np.empty((most + 1, len(crcs)), np.uint32)
    out[0] = crcs
    for k in range(1, most + 1):
        out[k] = _STEP[out[k - 1] & 255] ^ (out[k - 1] >> np.uint32(8))
    return out


class Vocabulary(dict):
    """word -> place in the lists of checksums, bytes and counts."""

    def __init__(self):
        super().__init__()
        self.crc, self.size, self.bytes = [], [], 0
        self.edited: Counter = Counter()
        self.pending: list[np.ndarray] = []
        self.n_pending, self.counts = 0, np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        self.crc.append(zlib.crc32(raw))
        self.size.append(len(raw))
        self.bytes += len(raw)
        at = self[word] = len(self)
        return at

    def add(self, text: bytes, name: bytes | None, ahead: np.ndarray) -> None:
        """Count the runs of a text; ahead: checksums of its name in front of short runs."""
        runs = _RUNS.findall(text.lower().decode(errors="replace"))
        if not runs:
            return
        at = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        if name is not None:
            used, back = np.unique(at, return_inverse=True)
            size = np.array([self.size[i] for i in used.tolist()])
            crc = np.array([self.crc[i] for i in used.tolist()], np.uint32) ^ ahead[np.minimum(size, SHORT_RUN)]
            long = np.flatnonzero(size > SHORT_RUN)
            if len(long):
                first = np.full(len(used), -1)
                first[back[::-1]] = np.arange(len(runs))[::-1]
                for i in long.tolist():
                    crc[i] = zlib.crc32(name + runs[first[i]].encode())
            picked = (crc % PICK == 0)[back]
            for i in np.flatnonzero(picked).tolist():
                run = runs[i]
                k = int(crc[back[i]]) % len(run)
                self.edited[run[:k] + run[k + 1 :]] += 1
            at = at[~picked]
        self.pending.append(at)
        self.n_pending += len(at)
        if self.n_pending >= HELD_RUNS:
            self.settle()

    def settle(self) -> None:
        fresh = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.pending]), minlength=len(self))
        fresh[: len(self.counts)] += self.counts
        self.counts, self.pending, self.n_pending = fresh, [], 0

    def full(self) -> bool:
        return len(self) + len(self.edited) >= HELD_WORDS or self.bytes >= HELD_BYTES

    def out(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        words = [*self, *(w for w in self.edited if len(w) >= MIN_LETTERS)]
        counts = [*self.counts.tolist(), *(n for w, n in self.edited.items() if len(w) >= MIN_LETTERS)]
        for i in range(0, len(words), 10_000):
            yield pa.RecordBatch.from_pydict({"word": pa.array(words[i : i + 10_000], pa.string()), "n": pa.array(counts[i : i + 10_000], pa.int64())})


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of docs(doc_id, text), for words of MIN_COUNT occurrences at least."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Vocabulary()
        for b in batches:
            names = [None if d is None else f"{d}:".encode() for d in b["doc_id"].to_pylist()]
            ahead = shifted(np.array([zlib.crc32(x or b"") for x in names], np.uint32), SHORT_RUN)
            for i, text in enumerate(as_bytes(b["text"])):
                held.add(text, names[i], ahead[:, i])
                if held.full():
                    yield from held.out()
                    held = Vocabulary()
        yield from held.out()

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


_P = (1 << 31) - 1
_BASES = (48_271, 69_621, 16_807, 1_583_458_089)
_END = 0x110000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), _P)) % np.uint64(_P)])
    return out[:n]


def _digests(word: str, edited: bool) -> list[bytes]:
    """Digests of the prefixes without one letter each, or of the whole rotations."""
    p, size = np.uint64(_P), len(word)
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    first = np.arange(size) + 1 if edited else np.arange(size + 1)  # where the front part starts
    last = first - 1 if edited else first  # and where the back part ends
    parts = []
    for base in _BASES:
        up, down = _powers(base, size + 2), _powers(pow(base, -1, _P), size + 2)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[:size] % p)]) % p
        front = (sums[size] + p - sums[first]) % p * down[first] % p
        end = np.uint64(_END) * up[size - first] % p
        back = sums[last] * up[size - first + 1] % p
        parts.append(((front + end + back) % p).astype("<u4"))
    rows = np.stack(parts, 1)
    head = b"\xff" + (size + (0 if edited else 1)).to_bytes(8, "little")
    return [head + r.tobytes() for r in rows]


def rotation_keys(word: str) -> tuple[list[bytes], list[int]]:
    """All keys of a word and what it is for each: 0 the shorter word of its key, 1 one of
    the words with a letter more, 2 the same, but the letter repeats the one before it."""
    size, ring = len(word), f"{word}\0{word}"
    role = [1 if i == 0 or word[i] != word[i - 1] else 2 for i in range(size)]
    if size <= TEXT_KEY:
        keys = [ring[i + 1 : i + 1 + size].encode() for i in range(size)]
    else:
        keys = _digests(word, True)
    if size + 1 <= TEXT_KEY:
        keys += [ring[i : i + size + 1].encode() for i in range(size + 1)]
    else:
        keys += _digests(word, False)
    return keys, role + [0] * (size + 1)


def _rotations(words: DataFrame) -> DataFrame:
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 20_000):
                cut = slice(i, i + 20_000)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[cut], pa.binary()), "id": pa.array(ids[cut], pa.int64()), "n": pa.array(counts[cut], pa.int64()), "role": pa.array(roles[cut], pa.int8())})

        for b in batches:
            keys, ids, counts, roles = [], [], [], []
            for id_, word, n in zip(b["id"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
                k, r = rotation_keys(word)
                keys += k
                roles += r
                ids += [id_] * len(k)
                counts += [n] * len(k)
                if len(keys) >= 20_000:
                    yield from out()
                    keys, ids, counts, roles = [], [], [], []
            yield from out()

    return words.select("id", "word", "n").mapInArrow(rotate, "key binary, id long, n long, role byte")


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and the best near word (best_n, best_id) of words(id, word, n) with ids in the
    order of the words; words without a near one do not occur."""
    key = Window.partitionBy("key")
    ranked = key.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("n", "id")
    scan = _rotations(words).select(
        "id",
        "role",
        F.first(member).over(ranked).alias("one"),
        F.nth_value(member, 2).over(ranked).alias("two"),
        F.count(F.when(F.col("role") > 0, 1)).over(ranked).alias("longer"),
        F.count(F.when(F.col("role") == 1, 1)).over(ranked).alias("counted"),
        F.count(F.when(F.col("role") == 0, 1)).over(ranked).alias("shorter"),
    )
    other = F.when(F.col("one.id") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    near = F.when(F.col("role") == 0, F.col("counted")).otherwise(F.col("longer") - 1 + F.when(F.col("role") == 1, F.col("shorter")).otherwise(0))
    found = scan.where("two is not null").select("id", near.alias("near"), other.alias("other"))
    best = F.max(F.struct(F.col("other.n").alias("n"), (-F.col("other.id")).alias("less")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best")).select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.less")).alias("best_id"))


def roots(links: DataFrame) -> DataFrame:
    """id and the last of the forms that follow from it, of links(id, form_id) without rings."""
    now = materialize(links.select("id", F.col("form_id").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        jump = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(jump, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
    return now.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of docs(doc_id, text)."""
    counted = materialize(word_counts(docs), "words")
    words = materialize(counted.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "words")
    discard(counted)
    formed = F.col("best_n") >= TIMES * F.col("n")
    near = words.select("id", "n").join(neighbours(words), "id").select("id", "n_near", F.when(formed, F.col("best_id")).alias("form_id"))
    near = materialize(near, "near")
    ends = roots(near.where("form_id is not null").select("id", "form_id"))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    linked = ends.select("id", F.col("root").alias("root_id")).join(near.select("id", "form_id"), "id").join(forms, "form_id").join(last, "root_id").select("id", "form", "form_n", "root")
    rows = words.join(near.select("id", "n_near"), "id", "left").join(linked, "id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
