"""Training-data operators against brute force on a small fixture with awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import bpe, boosting, media, packing, quality, sharding, similarity, substring, tokens, toxicity, url_filter, warc
from factorloom.llm.components import components

COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, fp long, bucket int, key long, digest long, component string"


def _texts():
    rng = random.Random(5)
    vocab = ["wort" + str(i) for i in range(300)] + ["straße", "été", "日本語", "it's", "<|endoftext|>", "a|b", "ALL"]
    draw = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, long = draw(45), draw(3000)
    out = [None, "", "   \n\t ", "one", "two words", draw(4), draw(19), draw(20), long, long, "😀 ​x  y\r\n z ", "a\nb\n\nb\nb c"]
    out += [shared, shared, draw(60) + "\n" + shared + " " + draw(60), draw(30) + " " + shared, " ".join(["same"] * 70), draw(70)]
    near = draw(200).split()
    for i in range(5):
        copy = list(near)
        copy[17 * i + 3] = f"changed{i}"
        out.append(" ".join(copy))
    out += [draw(80), draw(90).upper(), "x" * 30000]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "en", len(t or ""), 1, 2, 3, 4, "c") for i, t in enumerate(TEXTS)]
    rows += [rows[12], rows[13]]  # repeated rows
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


ROWS = [*enumerate(TEXTS), (12, TEXTS[12]), (13, TEXTS[13])]


def _words(t):
    return (t or "").encode().split()


def test_bpe_round_trip_equals_the_library(spark, docs, empty):
    tok = tokens.tokenizer(tokens.vocabulary_path())
    out = bpe.decode_documents(spark, bpe.encode_documents(spark, docs)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        want = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.text == tok.decode(want, skip_special_tokens=False)
    assert bpe.decode_documents(spark, bpe.encode_documents(spark, empty)).count() == 0


def test_word_cuts_never_change_ids():
    tok, path, rng = tokens.tokenizer(tokens.vocabulary_path()), tokens.vocabulary_path(), random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "B", "é", "'s", "1", "²", "!", "<|endoftext|>", "<|", "日本", "\u0085", "ß", "　", "😀", "x y", "\x1c", "́", "Ⅷ", "\xa0"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        assert tokens.encode_texts([s], path)[0].tolist() == tok.encode(s, add_special_tokens=False).ids, repr(s)


def test_media_payloads_come_back(spark, docs, empty):
    out = media.index_media(media.store_documents(spark, docs)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        raw = (TEXTS[r.doc_id] or "").encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.key_sizes == [576] * len(r.key_offsets) and len(r.key_offsets) == -(-len(want) // (576 * media.KEY_EVERY))
    assert media.index_media(media.store_documents(spark, empty)).count() == 0


def test_media_reader_follows_chunks_and_refuses_broken_boxes():
    payload = bytes(range(256)) * 9 * 33
    blob = media.write_container(payload)
    track = media.read_tracks(blob)[0]
    assert media.read_payload(blob, track) == payload and track["codec"] == "raw" and track["seconds"] == pytest.approx(len(payload) / media.TIMESCALE)
    with pytest.raises(ValueError):
        list(media.walk(memoryview(b"\x00\x00\x00\x40moov")))


def _brute_statistics(text):
    words = _words(text)
    lines, seen, dup = (text or "").encode().split(b"\n"), set(), 0
    for x in lines:
        if x.split():
            dup += x in seen
            seen.add(x)
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics_equal_brute_force(docs, empty):
    out = quality.document_statistics(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert tuple(r[c] for c in quality.BASE) == _brute_statistics(TEXTS[r.doc_id]), r.doc_id
    assert quality.document_statistics(empty).count() == 0


def test_quality_verdicts_without_labels_follow_the_base_rules(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, none).collect()
    assert all(r.kept == (not r.base_failed) for r in out)
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)


def test_trees_learn_and_respect_directions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + 0.4 * x[:, 1] ** 2) > 0.3).astype(float)
    model = boosting.train(x[:2000], y[:2000], [1, 0, 0])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    line = np.zeros((50, 3))
    line[:, 0] = np.linspace(-3, 3, 50)
    assert (np.diff(model.predict(line)) >= -1e-12).all()
    wrong = boosting.train(x[:2000], y[:2000], [-1, -1, -1])
    assert (np.diff(wrong.predict(line)) <= 1e-12).all()
    assert boosting.train(np.empty((0, 3)), np.empty(0), [0, 0, 0]).predict(line).tolist() == [0.5] * 50


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_held_out_accuracy(operator):
    base = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT d.doc_id, d.text, l.quality, l.toxic FROM '{base}/documents.parquet' d JOIN '{base}/labels.parquet' l USING (doc_id) ORDER BY hash(doc_id) LIMIT 2500").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows])
    texts = [r[1].encode() for r in rows]
    if operator == "quality":
        y = np.array([r[2] for r in rows], float)
        x = np.array([quality.statistics(t)[len(quality.BASE) :] for t in texts])
        p = boosting.train(x[~held], y[~held], list(quality.FEATURES.values())).predict(x[held])
        assert ((p >= 0.5) == y[held]).mean() > 0.97
    else:
        y = np.array([r[3] for r in rows])
        model = toxicity.train_toxicity([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
        meter = model.meter()
        p = model.trees.predict(np.array([meter.features(t) for t, h in zip(texts, held, strict=True) if h], float))
        hit = ((p >= 0.3) & (y[held] == 1)).sum()
        assert 2 * hit / ((p >= 0.3).sum() + y[held].sum()) > 0.75
        assert 0 <= p.min() and p.max() <= 1


def test_toxicity_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.keep_ordinary(docs, model).columns == docs.columns
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels)).count() == 0


def test_packing_covers_each_id_once(spark, docs, empty):
    tok = tokens.tokenizer(tokens.vocabulary_path())
    out = packing.pack_documents(spark, docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(d == i for d, _ in ROWS)
        assert sum(r.length for r in pieces[i]) == copies * len(ids)
        for r in pieces[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) and r.length > 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert packing.pack_documents(spark, empty).count() == 0


def test_bm25_prefers_the_like_document():
    idf = np.ones(50)
    docs = [[0, np.array([1, 2, 3, 4], np.uint32), 0], [1, np.array([9, 9, 9, 9], np.uint32), 0], [2, np.array([1, 2, 3, 8], np.uint32), 0]]
    assert packing.Shard(docs, idf, 4.0).neighbours(0).tolist()[1] == 2


def test_warc_revisits_and_reading_back(spark):
    big = "é" * 700
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "http://c", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "", None), (7, "http://f", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r.page_id: r for r in warc.read_bundles(warc.write_bundles(spark, pages)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert warc.read_bundles(warc.write_bundles(spark, pages.limit(0))).count() == 0


def test_bundles_are_seekable():
    writer, raws = warc.BundleWriter(), {}
    for i in range(40):
        raws[i] = warc.record(i, b"http://x", bytes([i]) * 20000, "d", None)
        writer.add(i, raws[i])
    reader = warc.BundleReader(writer.finish())
    assert len(reader.spans) > 2
    for page, frame, offset, n in reversed(reader.index):
        assert reader.read(frame, offset, n) == raws[page]


def test_shards_are_even_gapless_and_proportional(spark, docs, empty):
    out = sharding.stratified_shards(docs, shards=4).collect()
    sizes = defaultdict(list)
    for r in out:
        sizes[r.shard].append(r.slot)
    assert len(out) == len(ROWS) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    mix = sharding.stratified_shards(many, shards=8, keep=["source"]).groupBy("source", "shard").count().groupBy("source").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0]
    assert mix <= 2
    assert sharding.stratified_shards(empty).count() == 0


def _brute_dedup(rows, window=20):
    spans = sorted(((d, t) for d, t in rows), key=lambda x: x[0])
    first, out = {}, {}
    for d, t in spans:
        w = _words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, (d, k)), (d, k))
    for d, t in spans:
        w, cover = _words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (d, k):
                cover |= set(range(k, k + window))
        out[d] = [x for i, x in enumerate(w) if i not in cover]
    return out


def test_substring_dedup_equals_brute_force(docs, empty):
    want, texts = _brute_dedup(ROWS), dict(ROWS)
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        kept = want[r.doc_id]
        if len(kept) == len(_words(texts[r.doc_id])):
            assert r.text == texts[r.doc_id]
        else:
            assert r.text.encode() == b" ".join(kept), r.doc_id
    assert substring.remove_repeats(empty).count() == 0


def test_substring_dedup_with_bounded_automata(monkeypatch):
    monkeypatch.setattr(substring, "AUTOMATON_CODES", 40)
    words = [b"w%d" % i for i in range(60)]
    passages = [b" ".join(words[:40]), b" ".join(words[10:50]), b" ".join(words[5:45])]
    out = substring.Ranges()
    substring._locate(np.arange(3), passages, np.array([40, 40, 40]), np.array([1, 2, 3]), np.array([0, 0, 0]), np.array([0, 0, 0], np.uint32), 20, out)
    covered = defaultdict(set)
    for doc, _, start, end in out.columns:
        for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
            covered[d] |= set(range(a, b))
    assert covered == {2: set(range(30)), 3: set(range(40))}


def _brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(s), label[d]) for d, s in sets.items()}


@pytest.mark.parametrize("group, hot", [(256, 20_000), (2, 1)])
def test_similarity_components_equal_brute_force(spark, docs, monkeypatch, group, hot):
    monkeypatch.setattr(similarity, "GROUP", group)
    monkeypatch.setattr(similarity, "HOT", hot)
    rng = random.Random(8)
    base, extra = [f"b{i}" for i in range(80)], []
    for i in range(25):  # edits around the threshold: some link, some only through others
        w = list(base)
        for k in rng.sample(range(80), 1 + i % 4):
            w[k] = f"e{i}x{k}"
        extra.append((100 + i, " ".join(w)))
    both = docs.select("doc_id", "text", "fp", "bucket").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    want = _brute_components([*ROWS, *extra])
    for r in similarity.similarity_components(both).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id


def test_similarity_of_empty_table_and_rows_without_id(spark, empty):
    assert similarity.similarity_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in similarity.similarity_components(rows).collect()) == [(-1, -1), (4, 4)]
    assert similarity.keep_one_of_each(rows).count() == 2


def test_prefix_tree_prunes_without_losing_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(80)]
    tree = similarity.PrefixTree(sets)
    for q in sets[:30]:
        want = {i for i, s in enumerate(sets) if similarity.linked(len(q), len(s), len(np.intersect1d(q, s)), 75)}
        assert set(tree.probe(q, 75)) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


def test_url_rules(spark):
    urls = ["http://a.net", "http://a.net/", "https://X.EXAMPLE.net/en/1?q", "http://example.net/en", "http://example.com/de/x#y", "http://notexample.com/de/", "http://w.org/fr/", "http://w.org/fr", "no scheme.net/", None, "", "http://net/x", "http://a.net?/x", "http://ä.NET/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark, pages, url_filter.RULES).orderBy("page_id").collect()]
    assert got[0] == ("a.net", "", None, "allow") and got[1] == ("a.net", "/", "net/", "block")
    assert got[2] == ("x.example.net", "/en/1", "example.net/en/", "allow") and got[3][2:] == ("net/", "block")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11][2:] == ("net/", "block") and got[12] == ("a.net", "", None, "allow") and got[13][0] == "ä.net" and got[13][3] == "block"
    assert url_filter.filter_urls(spark, pages.limit(0), url_filter.RULES).count() == 0


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))
    index = url_filter.DigestIndex.mapped(url_filter.DigestIndex.build([("block", "aa", "/"), ("allow", "bb", "/"), ("block", "c", "/long")]))
    assert [i >= 0 and index.string(i) for i in index.find([b"bb/", b"aa/", b"zz/", b"c/long"])] == [b"bb/", b"aa/", False, b"c/long"]
