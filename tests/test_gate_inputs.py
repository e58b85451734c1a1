"""Orders and their gates start from few days, not from rows of every market day."""

import datetime as dt
import random

from factorloom.operators import portfolio as po
from factorloom.plans.panels import Panels
from factorloom.plans.registry import PLANS

DAY = lambda n: dt.date(1999, 1, 1) + dt.timedelta(n)


def test_gates_and_scaling_make_no_rows_of_every_day(spark):
    p = Panels(spark, "/root/testdata/sf0.001")
    assert PLANS["execution_gate"].build(p).count() > 0 and PLANS["cash_scaling"].build(p).count() > 0
    assert not {"accounts", "status", "daily", "stale"} & set(p.__dict__)
    days = p.step("rebalance_days", None)
    on = sorted(map(str, p.status_on(days).collect()))
    assert on and on == sorted(map(str, p.status.where(p.status.trade_date.isin([r.trade_date for r in days.collect()])).collect()))
    assert on == sorted(map(str, p.status_on(days).collect()))
    cash = lambda df: sorted((r.portfolio_id, r.cost_scenario, r.trade_date, round(r.cash, 4)) for r in df.collect())
    assert cash(p.cash) == cash(p.accounts)
    p.discard()


def test_positions_and_open_prices_before_days(spark):
    rng = random.Random(3)
    days = [DAY(n) for n in (-5, 10, 11, 30, 31, 45, 90)]
    ledger = [(f"P{i % 2}", i, DAY(n), rng.choice([0.0, 1e-13, -2.0, 3.0, 4.5])) for i in range(8) for n in sorted(rng.sample(range(60), 7))]
    bars = [(f"c{i}", i, DAY(n), rng.choice([None, 0.0, 5.0, 6.0]), rng.choice([None, 2.0, 3.0])) for i in range(9) for n in sorted(rng.sample(range(5, 70), 12))]
    on = spark.createDataFrame([(d,) for d in days], "trade_date date")
    held = po.positions_at(spark.createDataFrame(ledger, "portfolio_id string, code long, trade_date date, units_after double"), ["portfolio_id", "code"], on)
    want = {}
    for p, c in {(x[0], x[1]) for x in ledger}:
        for d in days:
            past = [x for x in ledger if x[:2] == (p, c) and x[2] < d]
            if past and past[-1][3] > po.EPSILON:
                want[p, c, d] = past[-1][3]
    rows = held.collect()
    assert {(r.portfolio_id, r.code, r.trade_date): r.units for r in rows} == want and len(rows) == len(want) > 10
    prices = {}
    for c in range(9):
        for d in days:
            opened = [x[3] for x in bars if x[1] == c and x[2] == d and (x[3] or 0) > 0]
            closes = [x[4] for x in bars if x[1] == c and x[2] < d and x[4] is not None]
            if opened or closes:
                prices[c, d] = (opened or closes[-1:])[0]
    got = po.open_prices(spark.createDataFrame(bars, "ts_code string, code long, trade_date date, open double, close double"), on, ["ts_code", "code"]).collect()
    assert {(r.code, r.trade_date): r.price for r in got} == prices and len(got) == len(prices)


def test_orders_of_held_and_absent_targets(spark):
    valued = spark.createDataFrame([("P", DAY(0), 1, 50.0, 100.0), ("P", DAY(0), 2, 50.0, 100.0), ("P", DAY(1), 1, None, 80.0), ("Q", DAY(0), 3, 10.0, 10.0)], "portfolio_id string, trade_date date, code long, current_value double, pretrade_nav double")
    targets = spark.createDataFrame([(DAY(0), 1, 0.5), (DAY(0), 4, 0.25), (DAY(1), 1, 0.5), (DAY(2), 1, 0.5)], "trade_date date, code long, target_weight double")
    got = {(r.portfolio_id, r.trade_date, r.code): (r.side, r.desired_notional) for r in po.rebalance_orders(valued, targets, "code").collect()}
    assert got == {("P", DAY(0), 2): ("SELL", 50.0), ("P", DAY(0), 4): ("BUY", 25.0), ("P", DAY(1), 1): ("BUY", 40.0), ("Q", DAY(0), 1): ("BUY", 5.0), ("Q", DAY(0), 3): ("SELL", 10.0), ("Q", DAY(0), 4): ("BUY", 2.5)}
