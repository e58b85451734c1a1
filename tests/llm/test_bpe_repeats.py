"""Inputs in which whole blocks repeat."""

from collections import Counter

import numpy as np

from factorloom.llm import bpe, tokens


def test_equal_blocks_are_encoded_alike(spark):
    tok = tokens.tokenizer(tokens.vocabulary_path())
    texts = ["one two two", None, "straße  日本語 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    single = spark.createDataFrame([(7, "same words")] * 5, "doc_id long, text string").repartition(5)
    want = {(i, tuple(tok.encode(t or "", add_special_tokens=False).ids)): 2 for i, t in enumerate(texts)}
    want[7, tuple(tok.encode("same words", add_special_tokens=False).ids)] = 5
    out = bpe.encode_documents(spark, docs.union(docs).union(single)).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want
