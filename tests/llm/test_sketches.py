"""Sketches that bound what two sets share, and the texts that are moved after them."""

import random

import numpy as np
import pytest

from factorloom.llm import similarity


def _sets(rng, n):
    out = []
    for _ in range(n):
        base = rng.integers(0, 1 << 63, int(rng.choice([1, 3, 40, 63, 64, 65, 500, 1100])), np.uint64)
        for share in (1.0, 0.95, 0.86, 0.8, 0.5, 0.1):
            keep = base[rng.random(len(base)) < share]
            out.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, len(base) - len(keep), np.uint64)])))
    return out


def test_sketches_lose_no_link_and_keep_unlike_sets_apart():
    sets = _sets(np.random.default_rng(7), 12)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    raw = similarity.sketches(np.concatenate(sets), at)
    table, apart, unlike = similarity.Sketches(np.diff(at), raw), 0, 0
    for s, x in zip(sets, raw, strict=True):
        for t, likely in zip(sets, table.likely(len(s), x, 75).tolist(), strict=True):
            both = len(np.intersect1d(s, t))
            assert likely or not similarity.linked(len(s), len(t), both, 75)
            if min(len(s), len(t)) > 30 and 2 * both < len(s) + len(t) - both:
                apart, unlike = apart + (not likely), unlike + 1
    assert unlike > 1000 and apart > 0.98 * unlike
    assert similarity.Sketches(np.empty(0, np.int64), []).likely(3, raw[0], 75).tolist() == []


def _docs(spark):
    """Texts that share a passage and are unlike otherwise, and one family of near copies."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage, base = [word() for _ in range(40)], [word() for _ in range(150)]
    rows = [(i, " ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))])) for i in range(90)]
    for i in range(90, 130):
        own = [word() if rng.random() < (0.01 if i % 3 else 0.04) else w for w in base]
        rows.append((i, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def _components(rows):
    hashes = similarity.WordHashes()
    sets = [similarity.shingle_set(t.encode(), hashes) for _, t in rows]
    union = similarity.Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if similarity.linked(len(a), len(sets[j]), len(np.intersect1d(a, sets[j])), 75):
                union.join(i, j)
    return {rows[i][0]: rows[union.find(i)][0] for i in range(len(rows))}


def test_texts_that_only_share_a_passage_are_not_moved(spark, monkeypatch):
    docs, rows = _docs(spark)
    monkeypatch.setattr(similarity, "HEAVY_MOST", 64)  # the passage's shingles do not all fit the table
    moved, kept = [], similarity._class_texts
    monkeypatch.setattr(similarity, "_class_texts", lambda *a: moved.append((t := kept(*a)).count()) or t)
    assert {r.doc_id: r.component_id for r in similarity.similarity_components(docs).collect()} == _components(rows)
    assert 0 < moved[0] <= 40


@pytest.mark.parametrize("cell", [1, 400, 1 << 21])
def test_components_in_cells_of_any_size(spark, monkeypatch, cell):
    monkeypatch.setattr(similarity, "SKETCH_CELL", cell)
    monkeypatch.setattr(similarity, "SET_CELL", cell)
    docs, rows = _docs(spark)
    family = [(d, t) for d, t in rows if d >= 90]
    got = {r.doc_id: r.component_id for r in similarity.similarity_components(docs.where("doc_id >= 90")).collect()}
    assert got == _components(family) and 1 < len(set(got.values())) < len(family)


def test_a_map_of_wanted_documents(spark, monkeypatch):
    monkeypatch.setattr(similarity, "WANTED_SLOTS", 1 << 12)
    monkeypatch.setattr(similarity, "WANTED_PART", 1 << 7)
    ids = spark.range(0, 3000, 3).toDF("doc_id")
    bits = np.unpackbits(similarity._map_of(ids))
    slots = [r.s for r in ids.select(similarity._slot().alias("s")).collect()]
    assert len(bits) == 1 << 12 and np.flatnonzero(bits).tolist() == sorted(set(slots))
