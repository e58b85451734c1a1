"""Long and repetitive texts, many blocks, and clashing names."""

import hashlib

import numpy as np

from factorloom.llm import bpe, substring, tokens


def test_words_of_many_blocks_are_encoded_in_several_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 200)
    monkeypatch.setattr(bpe, "GROUP_BLOCKS", 2)
    rows = [(i, f"the same words again and number {i % 7} é <|endoftext|> " * (1 + i % 5)) for i in range(120)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    assert bpe.EXPANSION * bpe.input_bytes(docs) // (bpe.BLOCK_CHARS * bpe.GROUP_BLOCKS) > 3
    tok = tokens.tokenizer(tokens.vocabulary_path())
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_documents(spark, docs).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_columns_whose_names_begin_like_own_ones_stay(spark):
    phrase = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "start " + phrase), (2, phrase + " end"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'a' as __doc", "doc_id", "'b' as __covered", "text", "'c' as __digest", "1 as __text", "2 as ___DOC")
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "start " + phrase and got[2].text == "end" and got[3].text == "short"
    assert all((r["__doc"], r["__covered"], r["__digest"], r["__text"], r["___DOC"]) == ("a", "b", "c", 1, 2) for r in got.values())


def test_a_text_of_megabytes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WORDS", 5000)
    rng = np.random.default_rng(0)
    phrase = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"u{x}" for x in rng.integers(0, 10**9, 300_000))  # about three million characters
    rows = [(1, long), (2, "x " + phrase + " y"), (3, long[:200_000].rsplit(" ", 1)[0] + " tail"), (4, (phrase + " ") * 400)]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got[1].text == long and got[2].text == rows[1][1] and got[3].text == "tail" and got[4].text == ""


def test_ranges_around_a_hot_anchor_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WORDS", 3000)
    monkeypatch.setattr(substring, "HOT_WORDS", 500)
    common = " ".join(f"c{i}" for i in range(24))
    rows = [(i, f"a{i} b{i % 3} {common} d{i % 2} e{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in substring.remove_repeats(df).collect()}
    want = {d: hashlib.sha256((" ".join(w) if len(w) < len(t.split()) else t).encode()).hexdigest() for (d, t), w in zip(rows, [kept for kept in _kept(rows)], strict=True)}
    assert got == want


def _kept(rows):
    """Words that stay, by looking up every window among all earlier ones."""
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    out = []
    for d, t in rows:
        w, gone = t.split(), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone.update(range(i, i + 20))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_merged_ranges():
    r = substring.Ranges()
    assert [r.add_one(1, -5, 3, 9), r.add_one(1, -5, 4, 10), r.add_one(1, -5, 10, 30), r.add_one(1, -5, 32, 40), r.add_one(2, -5, 33, 41)] == [1, 0, 0, 1, 1]
    (row,) = r.rows(1)
    assert [x.tolist() for x in substring.unpack(row[1])] == [[1, 1, 2], [-5, -5, -5], [3, 32, 33], [30, 40, 41]]
    assert r.rows(1) == []
