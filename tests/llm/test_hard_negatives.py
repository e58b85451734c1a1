"""Hard negatives against plain integer arithmetic."""

import numpy as np
import pytest

from factorloom.llm import hard_negatives as hn


def _brute(rows, every=50, low=50, high=95):
    """rows: (id, label, list of numbers); scores in unbounded integers."""
    usable = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, label, [int(np.floor(256 * np.float64(x))) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(usable):
        if i % every:
            continue
        cut = lambda s: max(-(2**63) + 1, min(2**63 - 2, s))
        scored = [(-cut(sum(x * y for x, y in zip(v, w, strict=False))), j, other) for b, (j, other, w) in enumerate(usable) if b != a]
        for p, pid, _ in sorted(x[:2] + (0,) for x in scored if x[2] == label)[:5]:
            fits = sorted(x[:2] for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)
            out += [(i, pid, r, n, -p, -s) for r, (s, n) in enumerate(fits[:3], 1)]
    return sorted(out)


def _run(spark, rows, **k):
    df = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    return sorted(tuple(r) for r in hn.mine(df.repartition(3), **k).collect())


def test_against_integers_with_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in rng.integers(-6, 7, 12) / 256]) for i in range(400)]
    rows += [rows[i] for i in (0, 50, 51, 7)] + [(50, 2, rows[3][2])]
    rows += [(None, 1, rows[0][2]), (500, None, rows[0][2]), (550, 1, None), (600, 1, [float("nan")] * 12), (650, 1, [1.0, None]), (700, 0, []), (750, 0, [1.0]), (800, 1, [1.7e308, 1.0])]
    want = _brute([r for r in rows if r[0] != 800])
    assert _run(spark, rows, block_rows=37, anchors_per_group=3) == want and len(want) > 60
    assert _run(spark, rows) == want


@pytest.mark.parametrize("size", [1.0, 1e4, 3e15, 1e30])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in np.floor(size * rng.normal(size=9))]) for i in range(60)]
    assert _run(spark, rows, every=10) == _brute(rows, every=10)


def test_empty_and_long(spark):
    assert _run(spark, []) == []
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=20_000)]) for i in range(12)]
    assert _run(spark, rows, every=4) == _brute(rows, every=4)


def test_product_of_residues():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**20), 2**20, (5, 3000)), rng.integers(-(2**20), 2**20, (7, 3000))
    got = hn.scores(hn.Side(a.astype(float)), hn.Side(b.astype(float)), slice(None), slice(None))
    assert (got == a @ b.T).all()


def test_query_ignores_further_columns(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    base.selectExpr("*", "'x' as block", "1 as id", "2 as vector", "3 as place").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in base.collect()]
    assert sorted(tuple(r) for r in hn.op11_hard_negatives(spark, str(tmp_path)).collect()) == _brute(rows)


def test_labels_at_the_end_of_their_type(spark, tmp_path):
    rows = [(0, [1.0], 2**31 - 1), (7, [1.0], 2**31 - 1), (1, [1.0], 2**31 - 1), (2, [0.9], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = _brute([(i, (x + 1) % 10 if i % 7 == 0 else x, v) for i, v, x in rows])
    assert sorted(tuple(r) for r in hn.op11_hard_negatives(spark, str(tmp_path)).collect()) == want
