"""Hashes of words by running sums, and the map before the table of heavy shingles."""

import pickle
import random

import numpy as np

from factorloom.llm import similarity
from factorloom.llm.word_hashes import WordHashes


def _check(texts, stretch):
    h, n = WordHashes(stretch).of_texts(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words] and len(h) == n.sum()
    flat = [w for ws in words for w in ws]
    of = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert of.setdefault(w, x) == x  # one hash for equal words, wherever they stand
    assert len(set(of.values())) == len(of)
    return of


def test_words_counts_and_hashes_do_not_depend_on_stretches():
    rng = random.Random(1)
    letters = "abAB \t\n\x0b\x0c\r\x1c\x85  é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))).encode() for _ in range(200)]
    texts += [b"", b" ", b"x" * 5000 + b" y", b"y " + b"X" * 4999, b"x" * 5000, b"x" * 64 + b" " + b"z" * 63 + b" ", b""]
    want = _check(texts, 1 << 17)
    for stretch in (1, 7, 64, 5000):
        assert _check(texts, stretch) == want
    assert WordHashes().of_texts([])[0].size == 0 and WordHashes().of_texts([b""])[1].tolist() == [0]


def test_many_words_and_permuted_letters_stay_apart():
    rng = random.Random(2)
    words = {"".join(rng.choice("ab01") for _ in range(rng.randrange(1, 24))).encode() for _ in range(200_000)}
    _check([b" ".join(words)], 1 << 17)


def test_weights_of_heavy_shingles_with_equal_first_bits():
    rng = np.random.default_rng(3)
    flat = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    names = np.unique(similarity._counted(flat[::3]))
    heavy = pickle.loads(pickle.dumps(similarity.Heavy(names[::-1], np.arange(8, 8 + len(names))[::-1])))
    near = np.concatenate([flat, flat ^ np.uint64(1 << 30)])  # the same bits in the map, another name
    table = dict(zip(names.tolist(), range(8, 8 + len(names)), strict=True))
    assert heavy.weights(near).tolist() == [table.get(int(x) >> 24, 0) for x in near]
    assert similarity.Heavy(np.empty(0, np.uint64), np.empty(0, np.int64)).weights(flat).tolist() == [0] * len(flat)
