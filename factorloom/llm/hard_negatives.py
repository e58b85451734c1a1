"""Hard negatives by exact integer scores: a residue-number-system matrix product, then selection
inside a window of scores.

1. Components become integers ``floor(256 * x)``. Tasks pack rows into blocks, which are written
   once; a row is named by its block and its place there.
2. Anchors are dealt to groups of about ``ANCHORS`` and every block meets every group in one cell of
   a grid. Within a cell blocks are streamed past the group, so a task holds one group, one
   block and the best rows so far.
3. A score matrix is the product of the component matrices modulo several small primes. Centred
   residues are multiplied in float32, cut along the components so that each partial sum stays
   below 2^24 and hence exact. Chinese remaindering gives the signed score. There are as many
   primes as the largest components of the two blocks call for.
4. A first pass keeps each anchor's best rows of its label; a second pass keeps, for each of
   them, the best rows of other labels whose score lies in its window.

Defined results: rows with a null id, label or vector, or with a null or non-finite component
(before or after scaling), take no part; an empty vector scores 0 with all; of vectors of unequal
length the shorter counts as filled up with zeros; equal scores are ordered by id; repeated rows
are rows of their own, so a copy of an anchor is one of its positives and a repeated anchor has
its results twice; a label that has no successor in 64 bits counts as null; scores beyond 64 bits are cut to the ends of that range; an empty table
gives an empty result; vectors of any length go through whole; other columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import discard, materialize, pack, small_batches, table, unpack

#: Rows of a block, its most components, anchors of a group, and anchors of one product.
BLOCK_ROWS, BLOCK_ITEMS, ANCHORS, TILE = 4096, 1 << 20, 2048, 512
_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _primes() -> list[int]:
    """Primes below 256 from the largest on, then the larger ones: enough for any double."""
    sieve = np.ones(2100, bool)
    sieve[:2] = False
    for i in range(2, 46):
        if sieve[i]:
            sieve[i * i :: i] = False
    found = np.flatnonzero(sieve).tolist()
    return [p for p in reversed(found) if p < 256] + [p for p in found if p > 256]


PRIMES = _primes()


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all integers from -bound to bound apart."""
    product, k = 1, 0
    while product <= 2 * bound:
        product *= PRIMES[k]
        k += 1
    return PRIMES[: max(1, k)]


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of integers kept as float64; fmod is exact."""
    r = np.fmod(m, p)
    r = r - p * (r > p // 2) + p * (r < -(p // 2))
    return r.astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p of centred residues, as int64 from 0 to p - 1."""
    depth, half = (1 << 24) // (p // 2) ** 2 if p > 3 else 1 << 22, a.shape[1]
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(0, half, depth):
        out += (a[:, i : i + depth] @ b[:, i : i + depth].T).astype(np.int64)
    return out % p


def signed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The integers of least size with these residues, by mixed radix digits."""
    product = 1
    for p in primes:
        product *= p
    wide = product >= 1 << 62
    value, scale = parts[0].astype(object) if wide else parts[0], primes[0]
    for r, p in zip(parts[1:], primes[1:], strict=True):
        digit = ((r - value % p) * pow(scale, -1, p)) % p
        value, scale = value + digit * scale, scale * p
    value = np.where(value > product // 2, value - product, value)
    return np.clip(value, _MIN + 1, _MAX - 1).astype(np.int64) if wide else value


class Side:
    """One side of a product: integers as float64, with residues made once for each prime."""

    def __init__(self, m: np.ndarray):
        self.m, self.largest = m, int(np.abs(m).max(initial=0))
        self._by_prime: dict[int, np.ndarray] = {}

    def mod(self, p: int) -> np.ndarray:
        if p not in self._by_prime:
            self._by_prime[p] = residues(self.m, p)
        return self._by_prime[p]


def scores(a: Side, b: Side, rows: np.ndarray | slice, columns: np.ndarray | slice) -> np.ndarray:
    """Exact inner products of some rows of a with some of b, as int64."""
    width = min(a.m.shape[1], b.m.shape[1])
    primes = primes_for(a.largest * b.largest * width)
    return signed([product_mod(a.mod(p)[rows, :width], b.mod(p)[columns, :width], p) for p in primes], primes)


def narrowest(m: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = np.abs(m).max(initial=0)
    return m.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def _block_rows(spark: SparkSession, rows: DataFrame, block_rows: int) -> DataFrame:
    """block, width and the packed ids, labels and components of rows(id, label, vector)."""
    small_batches(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, np.ndarray]] = []
        width = 0

        def out() -> pa.RecordBatch:
            nonlocal held, width, made
            held.sort(key=lambda x: x[1])  # equal labels side by side
            m = np.zeros((len(held), width))
            for i, (_, _, v) in enumerate(held):
                m[i, : len(v)] = v
            blob = pack(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), narrowest(m).ravel())
            block, made, held, width = (part << 32) + made, made + 1, [], 0
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "width": pa.array([m.shape[1]], pa.int32()), "data": [blob]})

        for b in batches:
            for id_, label, vector in zip(b["id"].to_pylist(), b["label"].to_pylist(), b["vector"], strict=True):
                values = vector.values
                if id_ is None or label is None or values is None or values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(256 * values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(v).all():
                    continue
                if held and (len(held) >= block_rows or (len(held) + 1) * max(width, len(v)) > BLOCK_ITEMS):
                    yield out()
                held.append((id_, label, v))
                width = max(width, len(v))
        if held:
            yield out()

    return rows.mapInArrow(build, "block long, width int, data binary")


def _opened(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, flat = unpack(data)
    return ids, labels, flat.astype(np.float64).reshape(len(ids), width)


_ANCHOR = "block long, place int, anchor_id long, label long, vector binary"


def _anchor_rows(blocks: DataFrame, every: int) -> DataFrame:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, width, data in zip(b["block"].to_pylist(), b["width"].to_pylist(), b["data"].to_pylist(), strict=True):
                ids, labels, m = _opened(data, width)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array(np.full(len(at), block), pa.int64()),
                        "place": pa.array(at, pa.int32()),
                        "anchor_id": pa.array(ids[at], pa.int64()),
                        "label": pa.array(labels[at], pa.int64()),
                        "vector": pa.array([m[i].tobytes() for i in at], pa.binary()),
                    }
                )

    return blocks.mapInArrow(pick, _ANCHOR)


class Group:
    """The anchors of a cell; windows and slots only in the second pass."""

    def __init__(self, t: pa.Table):
        self.block, self.place, self.id, self.label = (t[c].to_numpy() for c in ("block", "place", "anchor_id", "label"))
        vectors = [np.frombuffer(v, np.float64) for v in t["vector"].to_pylist()]
        m = np.zeros((len(vectors), max(map(len, vectors), default=0)))
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        self.side, self.positives = Side(m), t["positives"].to_pylist() if "positives" in t.column_names else None


def best(key: np.ndarray, score: np.ndarray, other: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key the rows of greatest score, ties by smaller id."""
    order = np.lexsort((other, -score, key))
    key, score, other = key[order], score[order], other[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(key)]])))
    kept = rank < most
    return key[kept], score[kept], other[kept]


class Best:
    """Running best rows of each key, and the score that a further row must reach."""

    def __init__(self, keys: int, most: int):
        self.most, self.floor = most, np.full(keys, _MIN)
        self.held = (np.empty(0, np.int64),) * 3

    def add(self, key: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if not len(key):
            return
        self.held = best(*(np.concatenate(x) for x in zip(self.held, (key, score, other), strict=True)), self.most)
        full, counts = np.unique(self.held[0], return_counts=True)
        ends = np.cumsum(counts) - 1
        self.floor[full[counts == self.most]] = self.held[1][ends[counts == self.most]]


class Positives:
    """First pass: the best rows of an anchor's label but the anchor itself."""

    schema = "block long, place int, positive_id long, positive_score long"

    def __init__(self, group: Group, most: int):
        self.group, self.best = group, Best(len(group.id), most)

    def meet(self, block: int, ids: np.ndarray, labels: np.ndarray, side: Side) -> None:
        g = self.group
        for label in np.intersect1d(g.label, labels):
            columns = np.flatnonzero(labels == label)
            of_label = np.flatnonzero(g.label == label)
            for i in range(0, len(of_label), TILE):
                rows = of_label[i : i + TILE]
                s = scores(g.side, side, rows, columns)
                r, c = np.nonzero(s >= self.best.floor[rows][:, None])
                other = (g.block[rows[r]] != block) | (g.place[rows[r]] != columns[c])
                r, c = r[other], c[other]
                self.best.add(rows[r], s[r, c], ids[columns[c]])

    def out(self) -> pa.RecordBatch:
        g, (key, score, other) = self.group, self.best.held
        return pa.RecordBatch.from_pydict({"block": pa.array(g.block[key], pa.int64()), "place": pa.array(g.place[key], pa.int32()), "positive_id": pa.array(other, pa.int64()), "positive_score": pa.array(score, pa.int64())})


class Negatives:
    """Second pass: for each positive the best rows of other labels inside its window."""

    schema = "block long, place int, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long"

    def __init__(self, group: Group, most: int, low: int, high: int):
        self.group, found = group, group.positives
        self.slots = max(map(len, found), default=0)
        n = len(found)
        # An empty window for slots without a positive.
        self.low, self.high = np.full((n, self.slots), _MAX), np.full((n, self.slots), _MIN)
        for i, row in enumerate(found):
            for j, p in enumerate(row):
                self.low[i, j] = -((-low * p["positive_score"]) // 100)
                self.high[i, j] = (high * p["positive_score"]) // 100
        self.best = Best(n * self.slots, most)

    def meet(self, block: int, ids: np.ndarray, labels: np.ndarray, side: Side) -> None:
        g = self.group
        if not self.slots:
            return
        for i in range(0, len(g.id), TILE):
            rows = np.arange(i, min(i + TILE, len(g.id)))
            floor = np.maximum(self.low[rows], self.best.floor.reshape(-1, self.slots)[rows])
            s = scores(g.side, side, rows, slice(None))
            r, c = np.nonzero((s >= floor.min(1)[:, None]) & (s <= self.high[rows].max(1)[:, None]))
            other = g.label[rows[r]] != labels[c]
            r, c = r[other], c[other]
            score = s[r, c]
            for j in range(self.slots):
                fits = (score >= floor[r, j]) & (score <= self.high[rows[r], j])
                self.best.add(rows[r[fits]] * self.slots + j, score[fits], ids[c[fits]])

    def out(self) -> pa.RecordBatch:
        g, (key, score, other) = self.group, self.best.held
        at, slot = key // max(1, self.slots), key % max(1, self.slots)
        found = [g.positives[i][j] for i, j in zip(at.tolist(), slot.tolist(), strict=True)]
        columns = {"block": g.block[at], "place": g.place[at].astype(np.int32), "anchor_id": g.id[at], "slot": slot.astype(np.int32), "positive_id": np.array([p["positive_id"] for p in found], np.int64), "positive_score": np.array([p["positive_score"] for p in found], np.int64), "negative_id": other, "negative_score": score}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _sweep(anchors: DataFrame, blocks: DataFrame, groups: int, lanes: int, start: Callable[[Group], Positives | Negatives], schema: str) -> DataFrame:
    """All blocks past all groups of anchors: one cell for each group and lane of blocks."""
    fields = [f.name for f in anchors.schema.fields if f.name != "part"]
    whole = anchors.select("part", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), *fields, F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("data"))
    empty = [F.lit(None).cast(anchors.schema[f].dataType).alias(f) for f in fields if f != "block"]
    passing = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"), "block", *empty, "width", "data")
    cells = whole.unionByName(passing).repartition(groups * lanes, "part", "lane").sortWithinPartitions("part", "lane", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], None
        for b in batches:
            cells_here = list(zip(b["part"].to_pylist(), b["lane"].to_pylist(), strict=True))
            kinds = b["kind"].to_pylist()
            for i, here in enumerate(cells_here):
                if here != cell:
                    if state is not None:
                        yield state.out()
                    cell, held, state = here, [], None
                if kinds[i] == 0:
                    held.append(b.slice(i, 1))
                elif held or state is not None:
                    if state is None:
                        state, held = start(Group(pa.Table.from_batches(held))), []
                    ids, labels, m = _opened(b["data"][i].as_py(), b["width"][i].as_py())
                    state.meet(b["block"][i].as_py(), ids, labels, Side(m))
        if state is not None:
            yield state.out()

    return cells.mapInArrow(run, schema)


def mine(
    rows: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_rows: int = BLOCK_ROWS,
    anchors_per_group: int = ANCHORS,
) -> DataFrame:
    """Hard negatives of rows(id long, label long, vector array of numbers).

    Anchors are rows whose id is divisible by ``every``. For each of an anchor's first
    ``positives`` other rows of its label: the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's."""
    spark = rows.sparkSession
    blocks = materialize(_block_rows(spark, rows, block_rows), "blocks")
    picked = materialize(_anchor_rows(blocks, every), "anchors")
    groups = max(1, -(-picked.count() // anchors_per_group))
    lanes = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    anchors = picked.withColumn("part", F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int"))

    of_anchor = Window.partitionBy("block", "place")
    near = _sweep(anchors, blocks, groups, lanes, lambda g: Positives(g, positives), Positives.schema)
    near = near.withColumn("slot", F.row_number().over(of_anchor.orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("slot") <= positives)
    lists = near.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_id", "positive_score"))).alias("positives"))
    known = materialize(anchors.join(lists, ["block", "place"]), "positives")

    far = _sweep(known, blocks, groups, lanes, lambda g: Negatives(g, negatives, low, high), Negatives.schema)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place", "slot").orderBy(F.desc("negative_score"), "negative_id")))
    out = materialize(far.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for t in (blocks, picked, known):
        discard(t)
    return out


def _label() -> Column:
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, F.try_add(label, F.lit(1).cast("long")) % 10).otherwise(label)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.select(F.col("vec_id").cast("long").alias("id"), _label().alias("label"), F.col("embedding").alias("vector")))


ORACLE = """
with rows_ as (
  select row_number() over () as row_id, vec_id,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
anchors as (select * from rows_ where vec_id % 50 = 0),
scored as (
  select a.row_id, a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    a.row_id = b.row_id as self, list_dot_product(a.v, b.v)::bigint as score
  from anchors a, rows_ b),
positives as (
  select *, row_number() over (partition by row_id order by score desc, other_id) as slot
  from scored where same and not self
  qualify slot <= 5),
negatives as (
  select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id,
    p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.row_id, p.slot order by n.score desc, n.other_id)::int as rank
  from positives p join scored n on n.row_id = p.row_id and not n.same
    and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from negatives where rank <= 3
"""
