"""Checks that derive figures once more find planted faults, and nothing else."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators import portfolio as po
from factorloom.operators import quality as qa

DAY = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)


def test_rederived_factors_find_planted_faults(spark):
    rng = random.Random(2)
    days = sorted(rng.sample(range(420), 330))
    price = {d: rng.uniform(5, 15) for d in days}
    ends = {}
    for d in days:
        ends[(DAY(d).year, DAY(d).month)] = d
    rows, months = [], sorted(ends)
    for i, m in enumerate(months):
        d, k = ends[m], days.index(ends[m])
        past = [price[x] for x in days[: k + 1]]
        returns = [b / a - 1 for a, b in zip(past, past[1:], strict=False)][-60:]
        momentum = past[-22] / past[-253] - 1 if k >= 252 else None
        # The first bar has no return: sixty of them are there from the sixty-first bar on.
        low = -statistics.stdev(returns) if len(returns) == 60 else None
        label = price[ends[months[i + 1]]] / price[d] - 1 if i + 1 < len(months) else None
        rows.append(("c", DAY(d), DAY(d), price[d], momentum, low, len(returns), label))
    schema = "canonical_ts_code string, signal_date date, asof_trade_date date, adjusted_price double, momentum_12_1 double, lowvol_60 double, volatility_observations long, next_month_return double"
    panel = spark.createDataFrame([("c", DAY(d), price[d], True, True, True) for d in days], "canonical_ts_code string, trade_date date, close_hfq double, is_sh_sz boolean, is_within_listing_window boolean, security_code_interval_valid boolean")
    tests = {
        "momentum": F.expr(qa.differs("momentum_12_1", "want_momentum", 1e-9)),
        "volatility": F.expr(qa.differs("lowvol_60 * lowvol_60", "CASE WHEN volatility_observations = 60 THEN want_variance END", 1e-9)),
        "label": F.expr(qa.differs("next_month_return", "want_label", 1e-9)),
    }

    def found(given):
        out = qa.checks(qa.rederived_factors(spark.createDataFrame(given, schema), panel), "X", tests).collect()
        return {r.check_id: r.observed for r in out}

    assert sum(r[4] is not None for r in rows) >= 2
    assert found(rows) == {"momentum": 0, "volatility": 0, "label": 0}
    bad = [list(r) for r in rows]
    bad[-1][4] += 1e-6
    bad[-2][5] -= 1e-3
    bad[0][7] = None
    assert found([tuple(r) for r in bad]) == {"momentum": 1, "volatility": 1, "label": 1}


def test_mean_rank_has_ties_in_the_middle(spark):
    values = [3.0, 1.0, 2.0, 2.0, 2.0, 9.0, 9.0]
    rows = spark.createDataFrame([("g", v) for v in values], T.StructType.fromDDL("g string, v double")).select("v", qa.mean_rank("v", ["g"]).alias("r")).collect()
    for r in rows:
        below, equal = sum(v < r.v for v in values), values.count(r.v)
        assert r.r == pytest.approx(below + (equal + 1) / 2)


def test_stale_summary_has_the_value_at_the_end(spark):
    rows = [("P", "a", DAY(1), 0, 50.0), ("P", "a", DAY(2), 1, 50.0), ("P", "a", DAY(3), 2, 50.0), ("P", "b", DAY(2), 5, 7.0), ("P", "b", DAY(3), 0, 150.0), ("Q", "a", DAY(3), 0, 9.0)]
    valued = spark.createDataFrame(rows, "portfolio_id string, code string, trade_date date, stale_calendar_days int, market_value double")
    nav = spark.createDataFrame([("P", DAY(3), 400.0), ("Q", DAY(3), 9.0)], "portfolio_id string, trade_date date, total_nav double")
    out = {(r.portfolio_id, r.code): r for r in po.stale_summary(valued, ["portfolio_id", "code"], nav).collect()}
    assert set(out) == {("P", "a"), ("P", "b")}
    a, b = out["P", "a"], out["P", "b"]
    assert (a.stale_at_end, a.terminal_value, a.terminal_weight, a.stale_days) == (True, 50.0, 0.125, 2)
    assert a.last_price_date == DAY(1)
    assert (b.stale_at_end, b.terminal_value, b.terminal_weight) == (False, None, None)
