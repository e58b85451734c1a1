"""One common run of words in very many different surroundings."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from factorloom.llm import substring
from factorloom.llm.common import WordHashes, unpack, window_hashes


def _anchor_run() -> list[str]:
    """A run with so small a hash that windows that hold it have it as their anchor."""
    rng, hashes = random.Random(2), WordHashes()
    runs = ([f"run{rng.randrange(10**6)}" for _ in range(substring.ANCHOR)] for _ in range(20_000))
    return min(runs, key=lambda r: int(window_hashes(hashes.of([w.encode() for w in r]), substring.ANCHOR)[0]))


def test_hot_anchor_with_more_distinct_words_than_code_points(spark):
    # Two rows each share 12 words before the run and 6 behind it; all else is a row's own.
    run, n = " ".join(_anchor_run()), 80_000
    pair, own = F.floor(F.col("doc_id") / 2), F.col("doc_id")
    words = lambda k, of, name: [F.concat(F.lit(f"{name}{i}x"), of.cast("string")) for i in range(k)]
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", *words(12, pair, "l"), F.lit(run), *words(6, pair, "r"), *words(6, own, "o")))
    got = substring.covered_ranges(docs).select("doc_id", "covered").collect()
    assert sorted(r.doc_id for r in got) == list(range(1, n, 2))
    assert {tuple(x.tolist() for x in map(np.asarray, unpack(r.covered))).__repr__() for r in got} == {"([0], [26])"}


def test_hot_anchors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_WORDS", 160)
    rng, run = random.Random(6), _anchor_run()
    vocab = [f"v{i}" for i in range(6)]
    rows = [(i, " ".join([*rng.choices(vocab, k=rng.randrange(25)), *run, *rng.choices(vocab, k=rng.randrange(25)), *run * (i % 2)])) for i in range(60)]
    rows += [(100 + i, " ".join([*vocab[:4] * 4, *run, *vocab * 3])) for i in range(20)]
    first, want = {}, defaultdict(set)
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (d, k)) != (d, k):
                want[d] |= set(range(k, k + 20))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: {x for a, b in zip(*unpack(r.covered), strict=True) for x in range(a, b)} for r in substring.covered_ranges(docs).collect()}
    assert got == want
