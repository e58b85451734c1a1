"""Near copies of which one side has no doc_id."""

import random

from factorloom.llm import similarity


def test_near_copies_without_id_on_either_side(spark):
    rng, hashes, rows, sides = random.Random(4), similarity.WordHashes(), [], set()
    for i in range(12):
        words = [f"w{i}x{rng.randrange(10**6)}" for _ in range(60)]
        texts = [" ".join(words), " ".join([*words[:-1], "other"])]
        rows += [(None, texts[0]), (i, texts[1])]
        a, b = (similarity.fingerprint(similarity.shingle_set(t.encode(), hashes)) for t in texts)
        sides.add(a < b)
    assert sides == {True, False}  # the row without doc_id comes first, and second
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in similarity.similarity_components(docs).collect() if r.doc_id is not None or r.component_id is not None)
    assert got == [(i, 56, i) for i in range(12)]
    assert similarity.keep_one_of_each(docs).count() == len(rows)
