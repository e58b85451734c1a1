"""The path between rebalances against a loop over legs."""

import datetime as dt
import random

import pytest

from factorloom.operators import portfolio as po
from factorloom.plans import registry


def test_drift_nav_equals_a_loop(spark):
    rng, day = random.Random(3), lambda m, d: dt.date(2000, m, d)
    bars = [(c, day(m, d), 10 * rng.uniform(0.8, 1.2), True) for c in "abcd" for m in range(1, 7) for d in range(1, 29) if rng.random() < 0.6]
    signals = [(day(m, 28), day(m + 1, 2) if m < 5 else None) for m in range(1, 6)]
    targets = [(c, s, rng.uniform(0.1, 0.3)) for s, _ in signals for c in rng.sample("abcd", 3)]
    cost, nav, old, want = 0.002, 1.0, {}, {}
    legs = [(s, t) for s, t in signals if t]

    def price(c, at):
        return max(((b[1], b[2]) for b in bars if b[0] == c and b[1] <= at), default=(None, None))[1]

    for i, (signal, start) in enumerate(legs):
        new = {c: w for c, s, w in targets if s == signal}
        turnover = sum(abs(new.get(c, 0) - old.get(c, 0)) for c in {*new, *old})
        nav *= 1 - cost * turnover
        growth = None
        if i + 1 < len(legs):
            grown = {c: w * (price(c, legs[i + 1][1]) / price(c, start) if price(c, start) else 1) for c, w in new.items()}
            growth = sum(grown.values()) + 1 - sum(new.values())
            old = {c: g / growth for c, g in grown.items()}
            nav *= growth
        want[signal] = (start, turnover, growth, nav)
    got = po.drift_nav(
        spark.createDataFrame(targets, "canonical_ts_code string, signal_date date, target_weight double"),
        spark.createDataFrame(signals, "signal_date date, scheduled_trade_date date"),
        spark.createDataFrame(bars, "canonical_ts_code string, trade_date date, close_hfq double, security_code_interval_valid boolean"),
        cost,
    ).collect()
    assert len(got) == len(want)
    for r in got:
        start, turnover, growth, nav = want[r.signal_date]
        assert r.trade_date == start and r.turnover == pytest.approx(turnover) and r.nav_at_end == pytest.approx(nav)
        assert (r.growth is None) == (growth is None) and (growth is None or r.growth == pytest.approx(growth))


def test_drift_nav_query_runs(spark):
    rows = registry.queries()["drift_nav"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.log_nav_at_end is not None for r in rows)
