"""Exact Jaccard join of documents on sets of word shingles, by prefix trees.

1. A first scan counts in how many texts each shingle occurs: blocks send their distinct
   shingles, packed, to buckets by value, which add up exact counts. The heaviest ones go into
   a table of at most HEAVY_MOST entries. All sets are ordered by (count in this table, else
   none; shingle): the same order everywhere, with common passages last.
2. A second scan gives each document its set's size and fingerprint. Documents with one
   fingerprint are one class; a block gives each of its classes with a list of its documents.
   Of two sets with similarity t or more, each has one of the other's elements among its first
   n - ceil(t n) + 1; these prefixes go, packed by block and without repeats within a block, to
   buckets by the shingle.
3. A bucket lists, for each shingle, the classes with it in their prefix. The class that comes
   first in the order of fingerprints is the head; heads and members are candidate pairs after
   bounds by size and position.
4. The second scan also gives each class a sketch, the parities of its shingles in one or two slots
   for each. Slots of two sets that differ are no more than the shingles that only one of both has, so sketches
   bound what two sets share, and pairs that cannot link go before any text is moved.
5. One compressed text of each class of the other pairs is kept; sets are made again from it where they
   are compared, as it is several times smaller than its set. The members of a head, in groups
   of bounded size, are put into a prefix tree by the global order; the head's set runs through
   it, sharing overlaps of common beginnings and leaving subtrees whose remaining length cannot
   reach the threshold.
6. Components of these links usually join each list. The members of all lists of a head are one
   group. Where its classes still lie in several components, those outside the largest one are
   compared again with all of the group, in cells of bounded size: first the sketches, then, of members
   that some sketch leaves a link, one block's tree with another block's sets, skipping pairs that are
   connected already. So no link between components is lost, and no group's pairs are all written out.

Defined results: a null or empty text, or one without words, has an empty set, is linked with
nothing and is its own component; fewer than k words are one shingle; copies and repeated rows
share a component; a row without doc_id gets no component and takes no part in links; an empty
table gives an empty result; other columns of the input are ignored. Texts of any length have
whole sets; ties in the order of prefixes go by the shingle, those of representatives by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import as_bytes, discard, materialize, mix, n_buckets, pack, small_batches, table, unpack, window_hashes
from factorloom.llm.components import components
from factorloom.llm.word_hashes import WordHashes

K, PERCENT = 5, 75
#: Bits that name a shingle where it is counted, texts from which one is heavy, and entries of
#: the table of the heaviest.
COUNT_BITS, HEAVY, HEAVY_MOST = 40, 8, 1 << 20
#: First bits of a shingle in the map of that table.
SEEN_BITS = 23
#: Shingles of a counted block; prefix entries and documents of a packed block; members of a
#: head, or of a list, that are compared at once; texts with a shingle from which its list is
#: dealt to several tasks.
COUNT_ENTRIES, BLOCK_ENTRIES, BLOCK_DOCS, GROUP, HOT = 1 << 22, 1 << 20, 1 << 17, 256, 20_000
#: Least slots of a sketch; shingles on one side of a cell of sketches, and of a cell of sets; slots
#: of the map of wanted documents, and those of one of its parts.
SKETCH_LEAST, SKETCH_CELL, SET_CELL, WANTED_SLOTS, WANTED_PART = 64, 1 << 22, 1 << 21, 1 << 23, 1 << 16


def shingle_set(text: bytes, hashes: WordHashes, k: int = K) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of k lower-cased words."""
    words = hashes.of_texts([text])[0]
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(k, len(words))))


def shingle_sets(texts: list[bytes], hashes: WordHashes, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The sets of many texts one behind the other, and where each begins (and the last ends)."""
    h, n = hashes.of_texts(texts)
    ends = np.cumsum(n)
    size = np.maximum(n - k + 1, 0)
    whole = window_hashes(h, k)[np.repeat(ends - n, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] if size.any() else np.empty(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.concatenate([window_hashes(h[ends[i] - n[i] : ends[i]], int(n[i])) for i in short])
        whole = np.insert(whole, (np.cumsum(size) - size)[short], own)
        size[short] = 1
    at = np.concatenate([[0], np.cumsum(size)])
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        whole[i:j].sort()
    fresh = np.ones(len(whole), bool)
    fresh[1:] = whole[1:] != whole[:-1]
    fresh[at[:-1][size > 0]] = True
    return whole[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def fingerprints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """63 bits of a hash of each whole set; -1 for an empty one."""
    size = np.diff(at)
    out = np.full(len(size), -1, np.int64)
    full = np.flatnonzero(size)
    if len(full):
        a, b = (np.add.reduceat(x, at[:-1][full]) for x in (mix(flat), mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
        out[full] = (mix(mix(a + mix(b)) + size[full].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return out


def fingerprint(shingles: np.ndarray) -> int:
    return int(fingerprints(shingles, np.array([0, len(shingles)]))[0])


def sketches(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set the parities of its shingles in slots, which are a power of two and no fewer than
    the shingles."""
    size = np.diff(at)
    slots = np.maximum(SKETCH_LEAST, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(slots)])
    slot = np.repeat(start[:-1], size) + (flat & np.repeat(slots - 1, size).astype(np.uint64)).astype(np.int64)
    out = np.zeros(start[-1] >> 3, np.uint8)
    np.bitwise_xor.at(out, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    raw, cuts = out.tobytes(), (start >> 3).tolist()
    return [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _folded(table: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one in a row, with as many slots as width says: half the slots are the parities of both halves."""
    while table.shape[-1] > width:
        half = table.shape[-1] // 2
        table = table[..., :half] ^ table[..., half:]
    return table


class Sketches:
    """Sketches of many sets, beside the sets' sizes, by their length."""

    def __init__(self, sizes: np.ndarray, raw: list[bytes]):
        self.sizes, length = sizes, np.fromiter(map(len, raw), np.int64, len(raw))
        self.tables = [(at := np.flatnonzero(length == n), np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1)) for n in np.unique(length)]

    def likely(self, n: int, raw: bytes, percent: int) -> np.ndarray:
        """Which sets can be linked with one of n shingles and that sketch: no other is."""
        out, own = np.zeros(len(self.sizes), bool), np.frombuffer(raw, np.uint64)
        for at, table in self.tables:
            size = self.sizes[at]
            near = np.flatnonzero(100 * np.minimum(size, n) >= percent * np.maximum(size, n))
            if len(near):
                width, size = min(table.shape[1], len(own)), size[near]
                differ = np.bitwise_count(_folded(table[near], width) ^ _folded(own, width)).sum(1, dtype=np.int64)
                both = np.minimum((n + size - differ) // 2, np.minimum(size, n))
                out[at[near]] = 100 * both >= percent * (n + size - both)
        return out


def _counted(shingles: np.ndarray) -> np.ndarray:
    return shingles >> np.uint64(64 - COUNT_BITS)


class Heavy:
    """The table of heavy shingles: names, sorted, and the texts that have each. A map of the names'
    first bits tells most other shingles apart without a search in the table."""

    def __init__(self, names: np.ndarray, texts: np.ndarray):
        order = np.argsort(names, kind="stable")
        self.names, self.texts = names[order], texts[order]
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self.names >> np.uint64(COUNT_BITS - SEEN_BITS)] = True

    def __reduce__(self) -> tuple:
        return Heavy, (self.names, self.texts)  # the map is made again where the table is read

    def weights(self, flat: np.ndarray) -> np.ndarray:
        """Texts with each shingle, 0 for all that are not heavy."""
        out = np.zeros(len(flat), np.int64)
        likely = np.flatnonzero(self.seen[flat >> np.uint64(64 - SEEN_BITS)])
        if len(likely):
            name = _counted(flat[likely])
            at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            out[likely] = np.where(self.names[at] == name, self.texts[at], 0)
        return out


def heavy_shingles(texts: DataFrame, buckets: int, k: int = K) -> Heavy:
    """Exact counts of all shingles over texts that differ within a block. Of each bucket the
    heaviest come to the driver, HEAVY_MOST at most over all; shingles are spread evenly."""
    width = -(-(1 << COUNT_BITS) // buckets)
    most = max(1, HEAVY_MOST // buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n, seen = WordHashes(), [], 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(names, np.arange(1, buckets + 1, dtype=np.uint64) * np.uint64(width))
            rows = []
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if a < b:
                    steps = np.diff(names[a:b] - np.uint64(i * width), prepend=np.uint64(0))
                    rows.append((i, pack(steps.astype(np.uint16), (steps >> np.uint64(16)).astype(np.uint32), np.packbits(counts[a:b] > 1), counts[a:b][counts[a:b] > 1].astype(np.uint32))))
            held, n = [], 0
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

        for b in batches:
            flat, at = shingle_sets(as_bytes(b["text"]), hashes, k)
            fps = fingerprints(flat, at)
            new = np.zeros(len(fps), bool)
            new[np.unique(fps, return_index=True)[1]] = True
            new &= np.fromiter((f not in seen for f in fps.tolist()), bool, len(fps))
            seen.update(fps.tolist())
            held.append(_counted(flat[np.repeat(new, np.diff(at))]))
            n += len(held[-1])
            if n >= COUNT_ENTRIES:
                yield flush()
        if n:
            yield flush()

    def add(rows: pa.Table) -> pa.Table:
        names, counts = [], []
        for x in rows["payload"]:
            low, high, many, times = unpack(x.as_py())
            names.append(np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 16)))
            own = np.ones(len(low), np.uint32)
            own[np.unpackbits(many, count=len(low)) == 1] = times
            counts.append(own)
        names, counts = np.concatenate(names), np.concatenate(counts)
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        total, names = np.add.reduceat(counts.astype(np.int64), first), names[first]
        heavy = np.flatnonzero(total >= HEAVY)
        heavy = heavy[np.argsort(-total[heavy], kind="stable")[:most]]
        return pa.table({"bucket": rows["bucket"][:1], "payload": pa.array([pack(names[heavy], total[heavy])], pa.binary())})

    names, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    heaviest = materialize(texts.select("text").mapInArrow(count, "bucket int, payload binary").groupBy("bucket").applyInArrow(add, "bucket int, payload binary"), "heavy")
    for r in heaviest.collect():  # HEAVY_MOST entries at most
        own, total = unpack(r.payload)
        names.append(own + r.bucket * width)
        counts.append(total)
    discard(heaviest)
    return Heavy(np.concatenate(names).astype(np.uint64), np.concatenate(counts))


def in_order(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: those that are not heavy first, then by texts."""
    return shingles[np.argsort(weights, kind="stable")] if weights.any() else shingles


def needed(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with any set that it links to."""
    return -(-percent * n // 100)


def linked(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


class PrefixTree:
    """Ordered sets as a tree kept as a sorted table: ``share[i]`` elements at its beginning
    are common to rows i - 1 and i, so rows below a node are consecutive."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.share = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.share.append(int(differ[0]) if len(differ) else n)
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in self.sets])])
        #: The tree's distinct elements, and each row's elements as places among them.
        self.elements, self.places = np.unique(np.concatenate([*self.sets, np.empty(0, np.uint64)]), return_inverse=True)

    def probe(self, query: np.ndarray, percent: int, skip=None) -> list[int]:
        """Places (in the given list) of the sets linked with the query, which is sorted by
        value. ``skip(i)`` says that the answer for set i is not wanted."""
        if not len(query) or not len(self.elements):
            return []
        own = np.minimum(np.searchsorted(self.elements, query), len(self.elements) - 1)
        marked = np.zeros(len(self.elements), bool)
        marked[own[self.elements[own] == query]] = True
        found, row, least, longest = [], 0, needed(len(query), percent), 100 * len(query) // percent
        path = np.zeros(1, np.int64)  # overlap after each element of the last row that was looked up
        known = 0  # elements at the beginning of the current row whose overlap path holds
        while row < len(self.sets):
            a, n = int(self.start[row]), len(self.sets[row])
            known = min(known, self.share[row])
            if not least <= n <= longest or (skip and skip(self.order[row])):
                row += 1
                continue
            tail = path[known] + np.cumsum(marked[self.places[a + known : a + n]])
            path = np.concatenate([path[: known + 1], tail])
            known = n
            if linked(len(query), n, int(path[-1]), percent):
                found.append(self.order[row])
                row += 1
                continue
            # The first node from which even a complete rest could not reach the threshold: no
            # row below it can link, whatever follows, as misses so far already exceed the slack.
            misses = np.arange(1, n + 1) - path[1:]
            dead = int(np.searchsorted(misses, longest - least, "right"))  # misses never fall
            row += 1
            if dead < n:
                while row < len(self.sets) and self.share[row] > dead:
                    row += 1
                known = dead + 1
        return found


class Union:
    """Components of small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _scan(docs: DataFrame, heavy: Heavy, buckets: int, k: int, percent: int) -> DataFrame:
    """Rows (bucket, kind, payload): of kind 1 the packed classes of a block with their sizes, sketches and
    documents, of kind 0 the packed prefixes of its distinct sets."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, hashes = sent.value, WordHashes()
        fps, sizes, prefixes, weights, held, seen = [], [], [], [], 0, set()
        owners: list[tuple] = []
        drawn: dict[int, bytes] = {}
        documents = 0

        def classes() -> list[tuple[int, int, bytes]]:
            fp, n, doc, valid = (np.concatenate(c) for c in zip(*owners, strict=True))
            order = np.lexsort((doc, valid, n, fp))
            fp, n, doc, valid = fp[order], n[order], doc[order], valid[order]
            first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (n[1:] != n[:-1])]))
            size = np.diff(first, append=len(fp))
            bucket = (mix((fp[first] ^ doc[first]).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for i in np.unique(bucket).tolist():
                chosen = bucket == i
                of = np.repeat(chosen, size)
                own = [drawn.get(x, b"") for x in fp[first][chosen].tolist()]
                rows.append((i, 1, pack(fp[first][chosen], n[first][chosen], size[chosen], doc[of], valid[of], np.fromiter(map(len, own), np.int64, len(own)), np.frombuffer(b"".join(own), np.uint8))))
            return rows

        def lists() -> list[tuple[int, int, bytes]]:
            token, weight = np.concatenate(prefixes), np.concatenate(weights)
            doc = np.repeat(np.arange(len(fps), dtype=np.uint32), [len(p) for p in prefixes])
            fp, size = np.array(fps, np.int64), np.array(sizes, np.uint32)
            pieces = 1 + weight // HOT  # lists of hot shingles are dealt to several tasks
            bucket = mix(token + (fp[doc] % pieces).astype(np.uint64)) % np.uint64(buckets)
            order = np.lexsort((token, bucket))
            ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
            rows = []
            for b, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if start < end:
                    at = order[start:end]
                    own, local = np.unique(doc[at], return_inverse=True)
                    short = token[at] >> np.uint64(16)  # 48 bits name a shingle here: another one of that name is a needless candidate
                    local = local.astype(np.min_scalar_type(len(own)))
                    rows.append((b, 0, pack(fp[own], size[own], short.astype(np.uint32), (short >> np.uint64(32)).astype(np.uint16), local, (pieces[at] > 1).astype(np.uint8))))
            return rows

        def flush() -> pa.RecordBatch:
            nonlocal held, documents
            rows = [*classes(), *(lists() if fps else ())]
            for x in (fps, sizes, prefixes, weights, seen, owners, drawn):
                x.clear()
            held = documents = 0
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "payload"])

        for b in batches:
            if not len(b):
                continue
            flat, at = shingle_sets(as_bytes(b["text"]), hashes, k)
            weight, fp = heavy.weights(flat), fingerprints(flat, at)
            valid = b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            owners.append((fp, np.diff(at), b["doc_id"].fill_null(0).to_numpy(), valid.astype(np.uint8)))
            documents += len(b)
            sketch = sketches(flat, at)
            for i in np.flatnonzero(valid & (fp >= 0)).tolist():
                name = int(fp[i])
                if name not in seen:
                    seen.add(name)
                    drawn[name] = sketch[i]
                    s, w, n = flat[at[i] : at[i + 1]], weight[at[i] : at[i + 1]], int(at[i + 1] - at[i])
                    order = np.argsort(w, kind="stable")[: n - needed(n, percent) + 1] if w.any() else slice(n - needed(n, percent) + 1)
                    fps.append(name)
                    sizes.append(n)
                    prefixes.append(s[order])
                    weights.append(w[order])
                    held += len(prefixes[-1])
            if held >= BLOCK_ENTRIES or documents >= BLOCK_DOCS:
                yield flush()
        if owners:
            yield flush()

    return docs.mapInArrow(scan, "bucket int, kind int, payload binary")


_FOUND = "kind int, a long, b long, ids array<long>, sketch binary"


def _classes(payloads: list[bytes]) -> pa.Table:
    """Kind 3: fingerprint, size, documents and sketch of a block's class; fingerprint and sketch are null for
    an empty set, the sketch is for a class without any doc_id, too."""
    parts = [unpack(x) for x in payloads]
    fp, n, size, doc, valid, width, sketch = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 7
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(doc, pa.int64(), mask=valid == 0))
    raw, cuts = sketch.tobytes(), np.concatenate([[0], np.cumsum(width)]).astype(int).tolist()
    drawn = pa.array([raw[i:j] or None for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.table({"kind": np.full(len(fp), 3, np.int32), "a": pa.array(fp, mask=fp < 0), "b": pa.array(n), "ids": ids, "sketch": drawn})


def _lists(rows: pa.Table, percent: int) -> pa.Table:
    """Of a bucket: kind 0, candidate pairs (head, member); kind 1, members of the groups of heads
    with lists of three and more (group, class); kind 2, heads of parts of hot lists (shingle, class);
    kind 3, the classes of its blocks."""
    kinds, payloads = rows["kind"].to_pylist(), rows["payload"].to_pylist()
    classes = _classes([x for k, x in zip(kinds, payloads, strict=True) if k == 1])
    parts = [unpack(x) for k, x in zip(kinds, payloads, strict=True) if k == 0]
    if not parts:
        return classes
    fp, size = np.concatenate([p[0][p[4]] for p in parts]), np.concatenate([p[1][p[4]] for p in parts]).astype(np.int64)
    token, hot = np.concatenate([p[2] | p[3].astype(np.uint64) << np.uint64(32) for p in parts]), np.concatenate([p[5] for p in parts])
    order = np.lexsort((fp, token))
    fp, size, token, hot = fp[order], size[order], token[order], hot[order]
    fresh = np.ones(len(fp), bool)
    fresh[1:] = (fp[1:] != fp[:-1]) | (token[1:] != token[:-1])
    fp, size, token, hot = fp[fresh], size[fresh], token[fresh], hot[fresh]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    counts = np.diff(first, append=len(token))
    head, of = np.repeat(first, counts), np.repeat(np.arange(len(first)), counts)
    fits = (head != np.arange(len(fp))) & (100 * np.minimum(size, size[head]) >= percent * np.maximum(size, size[head]))
    pairs = np.unique(np.stack([fp[head[fits]], fp[fits]], 1), axis=0) if fits.any() else np.empty((0, 2), np.int64)
    # A group is named by its head; a hot list keeps the shingle's name in all its parts.
    name = np.where(hot[first] > 0, mix(token[first]).astype(np.int64), fp[first])
    chosen = ((counts > 2) | (hot[first] > 0))[of]
    groups = np.unique(np.stack([name[of][chosen], fp[chosen]], 1), axis=0) if chosen.any() else np.empty((0, 2), np.int64)
    heads = first[hot[first] > 0]
    kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(groups), np.int32), np.full(len(heads), 2, np.int32)])
    a = np.concatenate([pairs[:, 0], groups[:, 0], token[heads].astype(np.int64)])
    b = np.concatenate([pairs[:, 1], groups[:, 1], fp[heads]])
    return pa.concat_tables([classes, pa.table({"kind": kind, "a": a, "b": b, "ids": pa.nulls(len(a), pa.list_(pa.int64())), "sketch": pa.nulls(len(a), pa.binary())}).cast(classes.schema)])


def _likely_pairs(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be links by their sketches."""
    side = lambda c: drawn.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b[c].to_pylist() for c in ("n_a", "n_b", "of_a", "of_b"))
            kept = [bool(Sketches(np.array([j]), [v]).likely(i, u, percent)[0]) for i, j, u, v in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(sift, "a long, b long")


def _slot(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(WANTED_SLOTS)).cast("int")


def _map_of(chosen: DataFrame) -> np.ndarray:
    """The slots of chosen(doc_id), as bits: a map of fixed size, made in parts."""

    def mark(rows: pa.Table) -> pa.Table:
        bits = np.zeros(WANTED_PART, bool)
        bits[rows["slot"].to_numpy() % WANTED_PART] = True
        return pa.table({"part": rows["part"][:1], "bits": pa.array([pack(np.packbits(bits))], pa.binary())})

    slots = chosen.select(_slot().alias("slot")).distinct().select((F.col("slot") / WANTED_PART).cast("int").alias("part"), "slot")
    out = np.zeros((WANTED_SLOTS // WANTED_PART, WANTED_PART // 8), np.uint8)
    for r in slots.groupBy("part").applyInArrow(mark, "part int, bits binary").collect():
        (out[r.part],) = unpack(r.bits)
    return out.reshape(-1)


def _class_texts(docs: DataFrame, least: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fp and the compressed text of the least document of each wanted class. A map of their ids keeps nearly
    all other texts out of the join."""
    chosen = least.where("doc_id is not null").join(wanted, "fp", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(_map_of(chosen))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, hashes = zstandard.ZstdCompressor(level=3), WordHashes()
        for b in batches:
            slot = b["slot"].to_numpy()
            b = b.filter(pa.array((sent.value[slot >> 3] << (slot & 7).astype(np.uint8)) & 128 > 0, pa.bool_()))
            if not len(b):
                continue
            texts = as_bytes(b["text"])
            # Rows may share a doc_id: the class's own text is the one with its fingerprint.
            own = pa.array(fingerprints(*shingle_sets(texts, hashes, k)), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], own, pa.array([zstd.compress(t) for t in texts], pa.binary())], ["doc_id", "fp", "packed"])

    texts = docs.where("doc_id is not null").select("doc_id", "text", _slot().alias("slot")).mapInArrow(squeeze, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, packed binary")
    return texts.join(chosen, ["doc_id", "fp"]).select("fp", "packed")


def _made_sets(packed: pa.ChunkedArray, heavy: Heavy, k: int) -> list[np.ndarray]:
    """The sets, in the global order, of compressed texts."""
    zstd = zstandard.ZstdDecompressor()
    flat, at = shingle_sets([zstd.decompress(x.as_py()) for x in packed], WordHashes(), k)
    weights = heavy.weights(flat)
    return [in_order(flat[i:j], weights[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _star_links(pairs: DataFrame, texts: DataFrame, made_sets, percent: int) -> DataFrame:
    """The pairs (a, b) that link; a's set runs through trees of at most about GROUP sets."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    members = dealt.join(texts.withColumnRenamed("fp", "b"), "b").select("a", "part", "b", "packed")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("fp", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "packed")

    def probe(rows: pa.Table) -> pa.Table:
        ids = rows["b"].to_pylist()
        made = made_sets(rows["packed"])
        query = np.sort(made[ids.index(None)])
        own = [i for i, x in enumerate(ids) if x is not None]
        found = PrefixTree([made[i] for i in own]).probe(query, percent)
        return pa.table({"a": pa.array([rows["a"][0].as_py()] * len(found), pa.int64()), "b": pa.array([ids[own[i]] for i in found], pa.int64())})

    return members.unionByName(heads).groupBy("a", "part").applyInArrow(probe, "a long, b long")


def _mixed_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (major, fp, component, asks) of the groups (list, fp) that lie in several components."""
    labelled = members.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").select("list", "fp", F.coalesce("component", "fp").alias("component"))
    # Of a group the largest component is known to hang together: only the others' members ask.
    # Groups with the same largest component are one, so a family's texts are sent about once.
    counts = labelled.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("components")).where("components > 1")
    return labelled.join(mixed.select("list", "major"), "list").select("major", "fp", "component", (F.col("component") != F.col("major")).alias("asks")).distinct()


def _in_cells(rows: DataFrame, drawn: DataFrame, most: int) -> DataFrame:
    """rows(major, fp, component, asks) with n, once for each cell (i, j) that they are asked or ask in;
    the members on one side of a cell have about ``most`` shingles."""
    rows = rows.join(drawn.select("fp", "n"), "fp")
    sizes = rows.groupBy("major").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).alias("asking"))
    rows = rows.join(sizes, "major")
    parts = lambda c: F.greatest(F.ceil(F.col(c) / most).cast("int"), F.lit(1))
    rows = rows.select("major", "fp", "n", "component", "asks", parts("size").alias("rows"), parts("asking").alias("columns"))
    rows = rows.withColumns({"own_i": F.pmod(F.xxhash64("fp"), "rows").cast("int"), "own_j": F.pmod(F.xxhash64("fp"), "columns").cast("int")})
    # A member is asked in its row of cells and, if it asks, asks in its column of cells.
    asked = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
    asking = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
    cells = F.when(F.col("asks"), F.array_union(asked, asking)).otherwise(asked)
    return rows.select("major", "fp", "n", "component", "asks", "own_i", "own_j", F.explode(cells).alias("cell")).select("*", "cell.i", "cell.j").drop("cell")


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of a cell's rows that are asked, and of those that ask."""
    asked = np.flatnonzero(rows["own_i"].to_numpy() == rows["i"].to_numpy())
    return asked, np.flatnonzero(rows["asks"].to_numpy() & (rows["own_j"].to_numpy() == rows["j"].to_numpy()))


def _likely_groups(groups: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Of groups(major, fp, component, asks) the members that sketches leave a link with another component of their
    group, and whether they ask for one."""

    def sift(rows: pa.Table) -> pa.Table:
        comps, size, raw = rows["component"].to_numpy(), rows["n"].to_numpy(), rows["sketch"].to_pylist()
        (asked, asking), kept = _sides(rows), {}
        table, of_asked = Sketches(size[asked], [raw[t] for t in asked]), comps[asked]
        for q in asking.tolist():
            met = asked[table.likely(int(size[q]), raw[q], percent) & (of_asked != comps[q])].tolist()
            if met:
                kept |= {q: True} | {t: kept.get(t, False) for t in met}
        at = pa.array(list(kept), pa.int64())
        return rows.select(["major", "fp", "component"]).take(at).append_column("asks", pa.array(list(kept.values()), pa.bool_()))

    placed = _in_cells(groups, drawn, SKETCH_CELL).join(drawn.select("fp", "sketch"), "fp")
    found = placed.groupBy("major", "i", "j").applyInArrow(sift, "major long, fp long, component long, asks boolean")
    return found.groupBy("major", "fp", "component").agg(F.bool_or("asks").alias("asks"))


def _group_links(groups: DataFrame, drawn: DataFrame, texts: DataFrame, made_sets: Callable, percent: int) -> DataFrame:
    """Links between different components within groups(major, fp, component, asks)."""
    placed = _in_cells(groups, drawn, SET_CELL).join(texts, "fp")

    def compare(rows: pa.Table) -> pa.Table:
        fps, comps = rows["fp"].to_pylist(), rows["component"].to_pylist()
        asked, asking = _sides(rows)
        made = made_sets(rows["packed"])
        places = {c: n for n, c in enumerate(dict.fromkeys(comps))}
        union, group = Union(len(places)), [places[c] for c in comps]
        tree, found = PrefixTree([made[n] for n in asked]), []
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        at = np.concatenate([[0], np.cumsum(sizes)])
        raw = sketches(np.concatenate(made), at)
        table = Sketches(sizes[asked], [raw[t] for t in asked])
        for q in asking:
            likely = table.likely(len(made[q]), raw[q], percent)
            for t in tree.probe(np.sort(made[q]), percent, lambda t, q=q, likely=likely: not likely[t] or union.find(group[asked[t]]) == union.find(group[q])):
                if union.join(group[asked[t]], group[q]):
                    found.append((fps[q], fps[asked[t]]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return placed.groupBy("major", "i", "j").applyInArrow(compare, "a long, b long")


def similarity_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_shingles and component_id: the least doc_id that can be
    reached by links, where two documents link if their shingle sets' Jaccard similarity is at
    least percent / 100."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    buckets = n_buckets(spark, docs)
    heavy = heavy_shingles(docs, buckets, k)
    found = materialize(_scan(docs, heavy, buckets, k, percent).groupBy("bucket").applyInArrow(lambda t: _lists(t, percent), _FOUND), "lists")
    classes = found.where("kind = 3").select(F.col("a").alias("fp"), F.col("b").alias("n_shingles"), "ids")
    # One row for each class before any join: its copies, however many, are not sent.
    least = classes.where("fp is not null").groupBy("fp").agg(F.min(F.array_min("ids")).alias("doc_id"))
    pairs, members = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("fp")).distinct()
    heads = found.where("kind = 2").select("a", "b")
    first = heads.groupBy("a").agg(F.min("b").alias("first"))
    pairs = pairs.union(heads.join(first, "a").where("b != first").select("first", "b")).distinct()
    wanted = found.where("kind < 2").select(F.explode(F.array(F.when(F.col("kind") == 0, F.col("a")), F.col("b"))).alias("fp")).where("fp is not null").distinct()
    drawn = found.where("kind = 3 and sketch is not null").select(F.col("a").alias("fp"), F.col("b").alias("n"), "sketch")
    drawn = materialize(drawn.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sketches")
    pairs = materialize(_likely_pairs(pairs, drawn, percent), "pairs")
    texts = materialize(_class_texts(docs, least, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), k), "texts")
    sent = spark.sparkContext.broadcast(heavy)
    made_sets = lambda packed: _made_sets(packed, sent.value, k)
    stars = materialize(_star_links(pairs, texts, made_sets, percent), "links")
    labels = components(stars)
    groups = materialize(_likely_groups(_mixed_groups(members, labels), drawn, percent), "groups")
    if groups.limit(1).count():
        others = materialize(_class_texts(docs, least, groups.select("fp").distinct().join(texts, "fp", "left_anti"), k), "texts")
        more = materialize(_group_links(groups, drawn, texts.union(others), made_sets, percent), "links")
        discard(others)
        if more.limit(1).count():
            discard(labels)
            labels = components(stars.union(more))
    for done in (texts, drawn, pairs, groups):
        discard(done)
    named = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    of_component = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = classes.join(named.join(of_component, "component").select("fp", "component_id"), "fp", "left")
    rows = placed.select(F.explode("ids").alias("doc_id"), "n_shingles", "component_id")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without those whose component has a lesser
    doc_id; rows without doc_id stay."""
    others = similarity_components(docs, k, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))
