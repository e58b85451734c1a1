"""Interval sweep and single-match look-up against comparing all with all."""

import datetime as dt
import random

import pytest

from factorloom.operators import intervals as iv

DAY0 = dt.date(2000, 1, 1)
SCHEMA = "ts_code string, effective_from date, effective_to date, v string"


def _d(n):
    return None if n is None else DAY0 + dt.timedelta(n)


def _history(rng, n, span):
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((rng.choice("AAAB"), a, rng.choice([None, a + rng.randrange(-3, 40), a, a + rng.randrange(span)]), f"v{i}"))
    return out + [out[0][:3] + ("twin",), ("C", None, 5, "x"), ("D", 7, 3, "reversed"), (None, 1, 9, "nobody"), (None, 2, 3, "nobody2")]


def _valid(h):
    return [(c, a, 10**6 if b is None else b, v) for c, a, b, v in h if a is not None and (b is None or b >= a)]


@pytest.mark.parametrize("span,bucket", [(30, 4), (900, 64), (900, 512)])
def test_pairs_equal_a_self_join(spark, span, bucket):
    history = _history(random.Random(span), 150, span)
    rows = _valid(history)
    want = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        want[c] = (len(own), sum(a[1] <= b[2] and b[1] <= a[2] for i, a in enumerate(own) for b in own[i + 1 :]))
    df = spark.createDataFrame([(c, _d(a), _d(b), v) for c, a, b, v in history], SCHEMA)
    got = {r.ts_code: (r.intervals, r.overlapping_pairs) for r in iv.overlapping_pairs(df, ["ts_code"], bucket).collect()}
    assert got == want and want["A"][1] > 100


def test_matches_are_counted_and_nested_intervals_found(spark):
    rng = random.Random(9)
    history = _history(rng, 12, 200)
    left = [(rng.choice(["A", "B", "E", None]), rng.randrange(260), i) for i in range(300)] + [("A", None, 900)]
    valid = _valid(history)
    df = spark.createDataFrame([(c, _d(a), _d(b), v) for c, a, b, v in history], SCHEMA)
    rows = spark.createDataFrame([(c, _d(d), i) for c, d, i in left], "ts_code string, trade_date date, row int")
    got = {r.row: r for r in iv.matches_of(rows, "trade_date", df, ["v"]).collect()}
    assert len(got) == len(left)
    for c, d, i in left:
        fits = [h for h in valid if c is not None and d is not None and h[0] == c and h[1] <= d <= h[2]]
        assert got[i].matches == len(fits) and got[i].v == max(((h[2], h[1], h[3]) for h in fits), default=(0, 0, None))[2]
    assert {r.matches for r in got.values()} >= {0, 1, 2}


def test_observation_counts_in_the_same_pass(spark):
    history = spark.createDataFrame([("A", _d(0), _d(10), "x"), ("A", _d(8), None, "y")], SCHEMA)
    rows = spark.createDataFrame([("A", _d(n)) for n in (-1, 3, 9, 10, 11)], "ts_code string, trade_date date")
    out, seen = iv.single_match(rows, "trade_date", history, ["v"])
    assert [r.v for r in sorted(out.collect(), key=lambda r: r.trade_date)] == [None, "x", "y", "y", "y"]
    assert seen.get == {"rows": 5, "unmatched": 1, "ambiguous": 2}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_strict_ends_the_job_on_an_overlap(spark):
    history = spark.createDataFrame([("A", _d(0), _d(10), "x"), ("A", _d(8), None, "y")], SCHEMA)
    rows = spark.createDataFrame([("A", _d(3))], "ts_code string, trade_date date")
    out, _ = iv.single_match(rows, "trade_date", history, ["v"], strict=True)
    assert [r.v for r in out.collect()] == ["x"]
    bad, _ = iv.single_match(rows.union(spark.createDataFrame([("A", _d(9))], rows.schema)), "trade_date", history, ["v"], strict=True)
    with pytest.raises(Exception, match="more than one interval"):
        bad.collect()
    assert [r.v for r in iv.only_match(rows, "trade_date", history, ["v"]).collect()] == ["x"]
    with pytest.raises(Exception, match="more than one interval"):
        iv.only_match(rows.union(spark.createDataFrame([("A", _d(9))], rows.schema)), "trade_date", history, ["v"]).select("ts_code").collect()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert iv.overlapping_pairs(none, ["ts_code"]).collect() == []
    rows = spark.createDataFrame([("A", _d(3))], "ts_code string, trade_date date")
    assert [(r.v, r.matches) for r in iv.matches_of(rows, "trade_date", none, ["v"]).collect()] == [(None, 0)]
