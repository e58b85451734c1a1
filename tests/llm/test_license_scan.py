"""The license scan against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from factorloom.llm import license_scan as ls

SF = "/root/testdata/sf0.001"


def _words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


def _brute(text):
    w, starts, base = _words(text), [], set()
    for phrase, label in ls.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    found, share = set(base), 0.0
    for label, notice in ls.TEMPLATES:
        t = _words(notice)
        grams, by_diagonal = defaultdict(list), defaultdict(set)
        for j in range(len(t) - ls.GRAM + 1):
            grams[tuple(t[j : j + ls.GRAM])].append(j)
        for i in range(len(w) - ls.GRAM + 1):
            for j in grams.get(tuple(w[i : i + ls.GRAM]), []):
                by_diagonal[i - j].add(j)
        held, before = set(), None
        for d in [*sorted(by_diagonal), None]:
            if before is not None and (d is None or d - before > ls.NEIGHBOUR):
                if len(held) / (len(t) - ls.GRAM + 1) >= ls.MIN_SHARE:
                    found.add(label)
                    share = max(share, len(held) / (len(t) - ls.GRAM + 1))
                held = set()
            held, before = held | by_diagonal.get(d, set()), d
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if starts else share)


def _texts():
    rng = random.Random(3)
    filler = "the a of und łódź naïve 42 x".split()
    out = [None, "", " .\n", "mit license", "MIT-License, mit LICENSE", "mit license", "general public license " * 3, "licenses mit licence"]
    for _, notice in ls.TEMPLATES:
        w = notice.split()
        for edits in (0, 1, 3, 8):
            v = list(w)
            for _ in range(edits):
                i = rng.randrange(len(v))
                v[i : i + rng.choice([0, 1])] = rng.choice([[], [rng.choice(filler)]])
            out.append(" ".join(rng.choices(filler, k=9)) + "\n" + " ".join(v) + "! " + " ".join(rng.choices(filler, k=5)))
    return out


def _run(df):
    rows = ls.license_spans(df)
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.col("spans.label"))), ",")
    share = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base"), labels.alias("labels"), share.alias("score")).collect()


def test_against_python_with_edits_and_clashing_columns(spark):
    texts = _texts()
    rows = list(enumerate(texts)) + [(None, texts[-1]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as words", "1 as row", "2 as label", "3 as at").repartition(3)
    got = sorted((tuple(r) for r in _run(df)), key=repr)
    assert got == sorted(((d, *_brute(t)) for d, t in rows), key=repr)
    assert sum("cc-by" in r[6] for r in got) > 3


def test_spans_say_where_a_notice_stands(spark):
    notice = ls.TEMPLATES[1][1]
    text = "one two three " + notice + " end " + " ".join(notice.split()[:30])
    (r,) = ls.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.label, s.first_word, s.n_words, s.share) for s in r.spans] == [("mit", 3, len(_words(notice)), 1.0)]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert _run(empty) == []
    long = "lorem ipsum " * 400_000 + ls.TEMPLATES[2][1] + " lorem" * 10
    (r,) = _run(spark.createDataFrame([(5, long)], "doc_id long, text string"))
    assert tuple(r) == (5, 800_000 + 8 + 10, 1, 800_003 - 1 + 1, 800_003, "apache", "apache", 1.0)


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = ls.op12_license_scan(spark, SF).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out}
    assert len(out) == len(docs) and got == {d: _brute(t) for d, t in docs.items()}


def test_no_python_on_the_main_path(spark):
    plan = ls.op12_license_scan(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
