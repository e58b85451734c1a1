"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``window`` consecutive words. Each window has an anchor, its least run of ANCHOR
words by hash, so equal windows have equal anchors at the same place.

1. A scan marks anchors that occur twice in a bitmap of fixed size, and lists the slots of hot
   ones. A slot shared by chance only costs work.
2. A second scan cuts out the passages around marked anchors. Of equal passages of a block the
   earliest goes on; the others are covered for certain. Passages go to shards by anchor. Around
   a hot anchor each window is a passage of its own and goes by its own hash, so that different
   surroundings of one common run are dealt to all shards and an automaton's size is bounded.
3. A shard confirms which windows recur, compiles automata of them in portions of bounded size
   and streams its passages through them to locate every occurrence; all but the earliest one
   of each window are covered.
4. Covered ranges are merged for each document and joined with the texts.

A passage in very many documents thus reaches its shard once for each block.

Defined results: a null or empty text, or one of fewer words than a window, stays as it is;
of rows that share doc_id and text none is earlier than another, so they lose the same words;
rows without doc_id are kept whole and not compared; an empty table gives an empty result;
other columns of the input stay as they are in ``remove_repeats``, whatever their names. Texts of
any length are worked through whole.
"""

from __future__ import annotations

import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import WordHashes, as_bytes, n_buckets, pack, small_batches, table, unpack, window_hashes

WINDOW, ANCHOR = 20, 8
#: Bits of the anchor bitmap and of one of its pieces (as powers of two).
SLOT_BITS, PIECE_BITS = 29, 22
#: Words of passages in a block, and of the passages that one automaton serves.
BLOCK_WORDS, AUTOMATON_WORDS = 4 << 20, 200_000
#: Words of the passages of one anchor from which it is hot.
HOT_WORDS = 640_000
_NO_WORD = 0x10FFFF  # separates passages in an automaton's input
_FIRST_WORD = 0xE000  # code points from here on stand for words


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of word hashes the place of its anchor; and the hashes of all runs."""
    runs = window_hashes(words, ANCHOR)
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), runs
    span = window - ANCHOR + 1
    return np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(n), runs


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def repeated_anchors(texts: DataFrame, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of the slots in which anchors occur twice or more, a fixed size; and the
    sorted slots of hot anchors, as many as the anchors' number by the bound at most."""
    most = max(2, HOT_WORDS // (2 * window - ANCHOR))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(slots, np.arange(1, (1 << SLOT_BITS - PIECE_BITS) + 1) << PIECE_BITS)
            rows = [(p, pack(np.diff(slots[a:b], prepend=slots[a:a] if a == b else np.uint32(p << PIECE_BITS)), np.packbits(counts[a:b] > 1), counts[a:b][counts[a:b] > 1].astype(np.uint32))) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["piece", "slots"])

        for b in batches:
            for text in as_bytes(b["text"]):
                at, runs = anchors(hashes.of(text.split()), window)
                if len(at):
                    held.append(_slots(runs[np.unique(at)]))
                    n += len(held[-1])
            if n >= 1 << 20:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        piece, slots, twice = rows["piece"][0].as_py(), [], []
        for x in rows["slots"]:
            steps, many, counts = unpack(x.as_py())
            slots.append(np.cumsum(steps, dtype=np.int64))
            times = np.ones(len(steps), np.int64)
            times[np.unpackbits(many, count=len(steps)) == 1] = counts
            twice.append(times)
        seen = np.bincount(np.concatenate(slots), np.concatenate(twice), 1 << PIECE_BITS)
        hot = np.flatnonzero(seen > most) + (piece << PIECE_BITS)
        return pa.table({"piece": pa.array([piece], pa.int32()), "slots": pa.array([pack(np.packbits(seen > 1), hot.astype(np.uint32))], pa.binary())})

    out = np.zeros(1 << SLOT_BITS - 3, np.uint8)
    size, hot = 1 << PIECE_BITS - 3, [np.empty(0, np.uint32)]
    # One row for each piece of the bitmap.
    for r in texts.select("text").mapInArrow(mark, "piece int, slots binary").groupBy("piece").applyInArrow(merge, "piece int, slots binary").collect():
        out[r.piece * size : (r.piece + 1) * size], own = unpack(r.slots)
        hot.append(own)
    return out, np.sort(np.concatenate(hot))


def _is_marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _slots(hashes)
    return (bits[slots >> np.uint32(3)] >> (np.uint32(7) - (slots & np.uint32(7))).astype(np.uint8)) & 1 == 1


class Ranges:
    """Covered ranges of words by document, packed for the parts that merge them. Single ranges are
    kept as plain integers, and one that continues the range before it in its text extends it."""

    #: Words that a held range counts for, by its memory.
    WORDS = 4

    def __init__(self) -> None:
        self.columns: list[tuple] = []
        self.single = array.array("q")

    def add(self, doc_id, digest, start, end) -> None:
        self.columns.append((doc_id.astype(np.int64), digest.astype(np.int64), start.astype(np.uint32), end.astype(np.uint32)))

    def add_one(self, doc_id: int, digest: int, start: int, end: int) -> int:
        """Add a range; how many ranges more are held."""
        one = self.single
        if len(one) and one[-4] == doc_id and one[-3] == digest and one[-2] <= start <= one[-1]:
            one[-1] = max(one[-1], end)
            return 0
        one.extend((doc_id, digest, start, end))
        return 1

    def rows(self, parts: int) -> list[tuple[int, bytes]]:
        if len(self.single):
            self.add(*np.frombuffer(self.single, np.int64).reshape(-1, 4).T)
            self.single = array.array("q")
        if not self.columns:
            return []
        cols = [np.concatenate(c) for c in zip(*self.columns, strict=True)]
        self.columns = []
        part = (cols[1].astype(np.uint64) >> np.uint64(7)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts), "right")
        return [(p, pack(*(c[order[a:b]] for c in cols))) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _shard_ranges(payloads: list[bytes], window: int) -> Ranges:
    """All but the earliest occurrence of each window in a shard's passages."""
    out = Ranges()
    docs, digests, starts, marks, passages = [], [], [], [], []
    for x in payloads:
        doc, digest, start, mark, text = unpack(x)
        docs.append(doc), digests.append(digest), starts.append(start), marks.append(mark)
        passages += text.tobytes().split(b"\n")
    doc, digest, start, mark = (np.concatenate(c) for c in (docs, digests, starts, marks))
    size = np.fromiter((p.count(b" ") + 1 for p in passages), np.int64, len(passages))
    # Equal passages of several blocks: the earliest goes on, later ones are covered whole.
    order, first, own, later = np.lexsort((start, doc)), {}, [], []
    for i in order.tolist():
        j = first.setdefault(passages[i], i)
        (later if j != i and (doc[j], start[j]) != (doc[i], start[i]) else own).append(i)
    if later:
        out.add(doc[later], digest[later], start[later], start[later] + size[later])
    order = np.array(own, np.int64)
    order = order[np.argsort(mark[order], kind="stable")]
    total, cut, done = np.cumsum(size[order]), 0, 0
    groups = np.flatnonzero(np.append(mark[order][1:] != mark[order][:-1], True)) + 1  # ends of the passages of one anchor
    for end in groups.tolist():
        if total[end - 1] - done >= AUTOMATON_WORDS or end == len(order):
            some = order[cut:end]
            _locate(some, [passages[i] for i in some], size, doc, digest, start, window, out)
            cut, done = end, total[end - 1]
    return out


#: Distinct words that the code points of one automaton are used for, at most.
AUTOMATON_CODES = 500_000


def _locate(own: np.ndarray, passages: list[bytes], size: np.ndarray, doc, digest, start, window: int, out: Ranges) -> None:
    codes = _Codes({b"\n": 0})  # stands for the separator behind each passage
    flat = np.fromiter(map(codes.__getitem__, (b" \n ".join(passages) + b" \n").split(b" ")), np.uint64)
    ends = np.cumsum(size[own] + 1) - 1
    begins = ends - size[own]
    h = window_hashes(flat * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), window)
    at = np.flatnonzero(np.repeat(ends, size[own] + 1)[: len(h)] >= np.arange(len(h)) + window)
    hashes, first, counts = np.unique(h[at], return_index=True, return_counts=True)
    recurring, portions = at[first[counts > 1]], 1 + len(codes) // AUTOMATON_CODES
    for n in range(portions):
        some = recurring[hashes[counts > 1] % np.uint64(portions) == n]
        if not len(some):
            continue
        chosen = np.zeros(len(own), bool)  # the passages with a window of this portion
        chosen[np.searchsorted(ends, at[np.isin(h[at], h[some])], "right")] = True
        _stream(np.flatnonzero(chosen), some, flat, begins, ends, own, doc, digest, start, window, out)


def _stream(chosen: np.ndarray, windows: np.ndarray, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, own: np.ndarray, doc, digest, start, window: int, out: Ranges) -> None:
    """Compile an automaton of the windows (places in flat) and stream the chosen passages."""
    places = np.concatenate([np.arange(begins[i], ends[i] + 1) for i in chosen])
    points = np.unique(np.append(flat[places], 0), return_inverse=True)[1]  # the separator is the least
    points = np.where(points == 0, _NO_WORD, points + _FIRST_WORD)[:-1]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, i in enumerate(np.searchsorted(places, windows).tolist()):
        automaton.add_word(text[i : i + window], n)
    automaton.make_automaton()
    hits = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
    place, which = places[hits[:, 0] - window + 1], hits[:, 1]
    passage = np.searchsorted(ends, place, "right")
    of = own[passage]
    where = start[of].astype(np.int64) + place - begins[passage]
    order = np.lexsort((where, doc[of], which))
    of, where, which = of[order], where[order], which[order]
    lead = np.maximum.accumulate(np.where(np.concatenate([[True], which[1:] != which[:-1]]), np.arange(len(which)), 0))
    later = (doc[of] != doc[of[lead]]) | (where != where[lead])
    of, where = of[later], where[later]
    if not len(of):
        return
    order = np.lexsort((where, of))
    of, where = of[order], where[order]
    begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (where[1:] != where[:-1] + 1)]))
    last = np.append(begin[1:], len(of)) - 1
    out.add(doc[of[begin]], digest[of[begin]], where[begin], where[last] + window)


def covered_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, digest (Spark's xxhash64 of the text) and covered: packed starts and ends of
    disjoint ranges of words that windows with an earlier occurrence cover."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    sent = spark.sparkContext.broadcast(repeated_anchors(docs, window))
    shards = n_buckets(spark, docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = sent.value
        hashes, seen, words_held = WordHashes(), {}, 0
        ranges = Ranges()

        def flush() -> pa.RecordBatch:
            by_shard: dict[int, list] = {}
            for passage, x in seen.items():
                by_shard.setdefault(x[3] % shards, []).append((*x, passage))
            rows = [(shards + p, x) for p, x in ranges.rows(shards)]
            for s, items in by_shard.items():
                doc, digest, start, mark, passages = zip(*items, strict=True)
                rows.append((s, pack(np.array(doc, np.int64), np.array(digest, np.int64), np.array(start, np.uint32), np.array(mark, np.uint64), np.frombuffer(b"\n".join(passages), np.uint8))))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "payload"])

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), as_bytes(b["text"]), strict=True):
                words = text.split()
                at, runs = anchors(hashes.of(words), window)
                if not len(at):
                    continue
                marked = np.flatnonzero(_is_marked(bits, runs[at]))
                if not len(marked):
                    continue
                digest = xxhash.xxh64_intdigest(text, 42)
                digest -= (digest >> 63) << 64
                single = np.isin(_slots(runs[at[marked]]), hot) if len(hot) else np.zeros(len(marked), bool)
                cuts = np.flatnonzero(np.concatenate([[True], single[1:] | (at[marked][1:] != at[marked][:-1]) | (marked[1:] != marked[:-1] + 1)]))
                firsts, lasts = marked[cuts].tolist(), marked[np.append(cuts[1:], len(marked)) - 1].tolist()
                for i, j, mark, alone in zip(firsts, lasts, runs[at[marked[cuts]]].tolist(), single[cuts].tolist(), strict=True):
                    passage = b" ".join(words[i : j + window])
                    if alone:
                        mark = xxhash.xxh64_intdigest(passage)
                    old = seen.get(passage)
                    if old is None:
                        seen[passage] = (doc_id, digest, i, mark)
                        words_held += j + window - i
                    elif (old[0], old[2]) < (doc_id, i):
                        words_held += Ranges.WORDS * ranges.add_one(doc_id, digest, i, j + window)
                    elif (old[0], old[2]) > (doc_id, i):
                        words_held += Ranges.WORDS * ranges.add_one(old[0], old[1], old[2], old[2] + j + window - i)
                        seen[passage] = (doc_id, digest, i, mark)
                    if words_held >= BLOCK_WORDS:  # a long text may fill several blocks
                        yield flush()
                        words_held = 0
        yield flush()

    def locate(rows: pa.Table) -> pa.Table:
        key = rows["key"][0].as_py()
        if key >= shards:  # ranges found within blocks
            return pa.table({"part": pa.array([key - shards] * len(rows), pa.int64()), "payload": rows["payload"]})
        made = _shard_ranges([x.as_py() for x in rows["payload"]], window).rows(shards)
        return pa.table({"part": pa.array([r[0] for r in made], pa.int64()), "payload": pa.array([r[1] for r in made], pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        doc, digest, start, end = (np.concatenate(c) for c in zip(*(unpack(x.as_py()) for x in rows["payload"]), strict=True))
        order = np.lexsort((start, digest, doc))
        doc, digest, start, end = doc[order], digest[order], start[order].astype(np.int64), end[order].astype(np.int64)
        out = []
        bounds = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])]))
        for a, b in zip(bounds, np.append(bounds[1:], len(doc)), strict=True):
            reach = np.maximum.accumulate(end[a:b])
            new = np.concatenate([[True], start[a + 1 : b] > reach[:-1]])
            begin = np.flatnonzero(new)
            out.append((doc[a], digest[a], pack(start[a:b][begin], reach[np.append(begin[1:], b - a) - 1])))
        d, g, c = zip(*out, strict=True)
        return pa.table({"doc_id": pa.array(d, pa.int64()), "digest": pa.array(g, pa.int64()), "covered": pa.array(c, pa.binary())})

    cut_rows = docs.mapInArrow(cut, "key long, payload binary")
    located = cut_rows.groupBy("key").applyInArrow(locate, "part long, payload binary")
    return located.groupBy("part").applyInArrow(merge, "doc_id long, digest long, covered binary")


def keep_words(text: bytes, covered: bytes | None) -> tuple[list[bytes], int]:
    """The words of a text outside the covered ranges, and how many it has in all."""
    words = text.split()
    if covered is None:
        return words, len(words)
    keep, at = [], 0
    for a, b in zip(*(x.tolist() for x in unpack(covered)), strict=True):
        keep += words[at:a]
        at = b
    return keep + words[at:], len(words)


def _with_ranges(docs: DataFrame, window: int) -> DataFrame:
    ranges = covered_ranges(docs, window)
    return docs.withColumn("digest", F.xxhash64("text")).join(ranges, ["doc_id", "digest"], "left").drop("digest")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages taken out of text: of a document that loses words the kept
    ones are joined by one space; others stay as they are. Columns and their types stay."""
    spark = docs.sparkSession
    small_batches(spark)
    free = "__"
    while any(c.lower().startswith(free) for c in docs.columns):  # names that the input does not have
        free += "_"
    doc, text, digest, covered = (free + x for x in ("doc", "text", "digest", "covered"))
    clear = docs.withColumns({doc: F.col("doc_id"), text: F.col("text")})
    ranges = covered_ranges(docs, window).withColumnsRenamed({"doc_id": doc, "digest": digest, "covered": covered})
    joined = clear.withColumn(digest, F.xxhash64(text)).join(ranges, [doc, digest], "left").drop(doc, digest, text)
    place = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if c is None else b" ".join(keep_words(t, c)[0]) for t, c in zip(b["text"].cast(pa.binary()).to_pylist(), b[covered].to_pylist(), strict=True)]
            columns = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != covered]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, [n for n in b.schema.names if n != covered])

    return joined.mapInArrow(rewrite, docs.schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = _with_ranges(docs, WINDOW)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [keep_words(t, c) for t, c in zip(as_bytes(b["text"]), b["covered"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([n for _, n in kept], pa.int64()), pa.array([n - len(w) for w, n in kept], pa.int64()), pa.array([b" ".join(w).decode() for w, _ in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    small_batches(spark)
    return joined.mapInArrow(count, "doc_id long, n_words long, n_removed long, kept string").select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
