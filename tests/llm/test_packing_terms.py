"""Queries of packing's BM25 index."""

import numpy as np

from factorloom.llm import packing


def test_common_terms_of_a_long_seed_count():
    idf = np.concatenate([np.full(100, 5.0), np.ones(100)])  # ids below 100 are rare
    seed = np.concatenate([np.arange(40), np.arange(100, 120)]).astype(np.uint32)
    other = np.arange(150, 170).astype(np.uint32)
    like = np.arange(100, 120).astype(np.uint32)  # shares only the seed's common ids
    docs = [[0, seed, 0], [1, other, 0], [2, like, 0]]
    assert packing.Shard(docs, idf, 30.0).neighbours(0).tolist() == [0, 2, 1]
