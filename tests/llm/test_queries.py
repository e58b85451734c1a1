"""The registered queries and the pipeline on a small table, against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _brute_components, _brute_dedup

import corpus_pipeline
from factorloom.llm import bpe, packing, quality, sharding, similarity, substring, tokens, toxicity

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Two thirds of the smallest documents, with awkward rows and a repeated one."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{BASE}/documents.parquet").where("doc_id % 3 < 2")
    columns = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = [(90001, None), (90002, ""), (90003, " \n "), (90004, "one two <|endoftext|> été"), (90005, "word " * 4000)]
    more = spark.createDataFrame(extra, "doc_id long, text string").select(*(F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
    rows = docs.union(more.select(docs.columns))
    rows.union(rows.where("doc_id = 4 or doc_id = 90004")).withColumn("fp", F.lit("clash")).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{BASE}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _ids(text):
    return tokens.tokenizer(tokens.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_op1_digests(spark, sf_dir, rows):
    tok = tokens.tokenizer(tokens.vocabulary_path())
    want = sorted((d, len(i := _ids(t)), _sha(np.array(i, "<u4").tobytes()), _sha(tok.decode(i, skip_special_tokens=False).encode())) for d, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe_roundtrip(spark, sf_dir).collect()) == want


def test_op2_verdict_follows_base_rules_and_trees(spark, sf_dir, rows):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees, out = quality.train_quality(docs, labels), quality.op2_quality_rules(spark, sf_dir).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in out) == sorted(d for d, _ in rows)
    for r in out:
        s = quality.statistics((texts[r.doc_id] or "").encode())
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == s[:5] and r.base_failed == failed
        assert r.kept == (not failed and bool(trees.predict(np.array([s[5:]], float))[0] >= quality.KEEP_FROM))


def _check_pieces(pieces, want):
    """want: doc_id -> the ids of each of its rows, all alike."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert set(by_doc) == set(want)
    for doc, group in by_doc.items():
        ids, copies = want[doc]
        raw = np.array(ids, "<u4")
        assert sum(r.length for r in group) == copies * len(ids) and all(r.doc_tokens == len(ids) for r in group)
        covered = np.zeros(len(ids), int)
        for r in group:
            covered[r.start : r.start + r.length] += 1
            assert r.ids_crc32 == zlib.crc32(raw[r.start : r.start + r.length].tobytes())
        assert (covered == copies).all()
    return len(by_sequence)


def test_op4_pieces(spark, sf_dir, rows):
    pieces, want = packing.op4_lexical_packing(spark, sf_dir).collect(), {}
    for d, t in rows:
        want[d] = ([*_ids(t), packing.END_ID], want.get(d, (None, 0))[1] + 1)
    n, total = _check_pieces(pieces, want), sum(len(i) * c for i, c in want.values())
    assert (n - spark.sparkContext.defaultParallelism - 8) * packing.WINDOW <= total  # one open window a partition
    again = packing.pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))  # the order of rows does not matter


def test_op4_neighbours_equal_bm25_by_definition():
    rng = np.random.default_rng(2)
    docs = [[i, rng.zipf(1.5, rng.integers(5, 60)).clip(0, 99).astype("<u4"), 0] for i in range(40)]
    idf = rng.uniform(0.1, 3, 100)
    for dense in (1, 8, 10**6):
        packing.DENSE, before = dense, packing.DENSE
        index = packing.Shard(docs, idf, 30.0)
        packing.DENSE = before
        for seed in range(0, 40, 5):
            scores = []
            for _, ids, _ in docs:
                tf = {t: int((ids == t).sum()) for t in set(ids.tolist()) & set(docs[seed][1].tolist())}
                scores.append(sum(idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(ids) / 30)) for t, n in tf.items()))
            got = np.array(scores)[index.neighbours(seed)]
            assert (np.diff(got) <= 1e-9).all()


def test_op6_columns(spark, sf_dir, rows):
    out, sizes = sharding.op6_stratified_sharding(spark, sf_dir).collect(), defaultdict(list)
    want = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == want and {r.law for r in out} == {"rows"}
    for r in out:
        sizes[r.shard].append(r.slot)
    assert set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1


def _score(model, text):
    """By definition: each window compressed with each dictionary by itself."""
    saved = [len(model.meter().by_ordinary(w)) - len(model.meter().by_toxic(w)) for w in toxicity.windows((text or "").encode())]
    counts = [sum(s >= least for s in saved) for least in toxicity.SAVED]
    return float(model.trees.predict(np.array([[*counts, *(100 * c / (20 + len(saved)) for c in counts), max([0, *saved]), len(saved)]], float))[0])


def test_op7_columns(spark, sf_dir, rows):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, texts = toxicity.fit(docs, labels, ~toxicity.held_out()), dict(rows)
    out = toxicity.op7_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(d for d, _ in rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    for r in sorted(out, key=lambda r: r.doc_id)[::20]:
        assert r.score == pytest.approx(_score(model, texts[r.doc_id]))


def test_windows_hold_all_words_in_order():
    for text in (b"", b" \n", b"one", b"A b\tc d e f g h i  j", b"w " * 33, "é ü".encode() * 9):
        got = [bytes((c - toxicity.SHIFT * i) % 256 for i, c in enumerate(w)) for x in toxicity.windows(text) for w in x.split(b" ") if w]
        assert got == text.lower().split()
        assert all(len(x.split(b" ")) <= toxicity.WINDOW_WORDS + 2 for x in toxicity.windows(text))


def test_op8_digests(spark, sf_dir, rows):
    kept = _brute_dedup(rows)
    want = sorted((d, n := len((t or "").encode().split()), n - len(kept[d]), _sha(b" ".join(kept[d]))) for d, t in rows)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.op8_substring_dedup(spark, sf_dir).collect()) == want


def test_op9_components(spark, sf_dir, rows):
    want = _brute_components(rows)
    out = similarity.op9_ngram_jaccard_join(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted((d, *want[d]) for d, _ in rows)


def test_heavy_shingles_are_counted_exactly(spark):
    docs = spark.createDataFrame([(f"a b c d e f{i % 30} g{i}",) for i in range(120)], "text string").repartition(5)
    heavy = similarity.heavy_shingles(docs, 64)
    sets = [similarity.shingle_set(f"a b c d e f{i % 30} g{i}".encode(), similarity.WordHashes()) for i in range(120)]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    assert heavy.weights(values).tolist() == [c if c >= similarity.HEAVY else 0 for c in counts.tolist()]


def test_pipeline_equals_a_chain_by_brute_force(spark, sf_dir, rows):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.op2_quality_rules(spark, sf_dir).collect() if r.kept}
    model = toxicity.fit(docs.where(F.col("doc_id").isin(sorted(good))), labels, ~toxicity.held_out())
    left = [(d, t) for d, t in rows if d in good and _score(model, t) < toxicity.TOXIC_FROM]
    label = _brute_components(left)
    left = [(d, t) for d, t in left if label[d][1] == d]
    kept, want = _brute_dedup(left), {}
    for d, t in left:
        text = t if len(kept[d]) == len(t.encode().split()) else b" ".join(kept[d]).decode()
        want[d] = ([*_ids(text), packing.END_ID], want.get(d, (None, 0))[1] + 1)
    assert len(want) > 20
    _check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), want)


def test_stages_on_awkward_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    awkward = docs.limit(20).drop("n_chars").union(docs.limit(1).drop("n_chars").withColumn("doc_id", F.lit(None).cast("long")).select(docs.drop("n_chars").columns))
    for table in (docs.limit(0), awkward):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, sf_dir).columns == table.columns
            assert stage(spark, table, sf_dir).count() <= table.count()
