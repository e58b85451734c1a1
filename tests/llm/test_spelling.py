"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from factorloom.llm import spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [u for u in n if _near(w, u)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], -1)) for w in n)


def _run(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df).collect())


def test_against_all_pairs(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abÀéÿ") for _ in range(rng.randint(5, 7))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    rows = []
    for d in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxÉ") + w[i:], w[:i] + rng.choice("abxÉ") + w[i + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((d, rng.choice([" ", "3", "\n", "ā", "…"]).join(words)))
    rows += [(None, "AAAAA aaaaab 东aaaaab"), (1, None), (2, ""), rows[0], rows[0], (3, "ßßßßß ßßßßß ßßßß÷ ×ßßßß ßßßßß " * 3)]
    want = _brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as id", "'x' as word", "0 as n").repartition(4)
    assert _run(df) == want
    assert sum(x[1] != "" for x in want) > 20 and any(x[1] != x[2] and x[1] for x in want)


def test_long_runs_use_digests(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé") for _ in range(80))
    edits = [base, base[:40] + base[41:], base[:7] + "ü" + base[8:], base + "z", base[:64], base[:63], base[:62] + "y", base[:65]]
    rows = [(i, " ".join([w] * (3 + 4 * k))) for i, w in enumerate(edits) for k in range(2)]
    assert _run(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_a_run_of_a_million_letters(spark):
    long = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 1_000_000))
    rows = [(i, w) for i, w in enumerate([long] * 6 + [long[:500_000] + long[500_001:]] * 3)]
    got = {len(r.word): r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    h = [zlib.crc32(f"{i}:{w}".encode()) % 97 for i, w in rows]
    assert all(h) and sorted(got) == [999_999, 1_000_000]
    assert got[999_999].form == long and got[999_999].n_near == 1 and got[1_000_000].form is None and got[1_000_000].n_near == 1


def test_empty_table(spark):
    assert _run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_checksum_behind_a_prefix():
    names = [f"{i * 7919}:".encode() for i in range(50)]
    ahead = spelling.shifted(np.array([zlib.crc32(x) for x in names], np.uint32), 9)
    for k in range(10):
        run = b"variation"[:k]
        assert [zlib.crc32(x + run) for x in names] == (ahead[k] ^ np.uint32(zlib.crc32(run))).tolist()


def test_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = spelling.op13_spelling_variants(spark, sf).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in out) == _brute(rows)
