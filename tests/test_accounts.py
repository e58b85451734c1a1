"""Daily accounts and experiment metrics against loops over days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import performance as pf
from factorloom.operators import portfolio as po
from factorloom.operators import robustness as rb

DAY = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
RATES = {"LOW": 0.001, "HIGH": 0.01}


def _fixture(spark):
    rng = random.Random(5)
    market = [d for d in range(60) if d % 7 < 5]
    orders = []
    for n in range(80):
        d, code, side, status = rng.choice(market[3:]), rng.choice("abc"), rng.choice(["BUY", "BUY", "SELL"]), rng.choice(["FILLED", "FILLED", "FAILED", "PARTIAL_CASH_CONSTRAINT"])
        units = 0.0 if status == "FAILED" else float(rng.randint(1, 9))
        orders.append((rng.choice(["P0", "P1"]), code, DAY(d), side, status, units * 10, units))
    bars = [(c, DAY(d), rng.uniform(5, 15)) for c in "abc" for d in market if rng.random() < 0.7]
    index = [(DAY(d), rng.uniform(90, 110)) for d in market]
    return orders, bars, index


def _accounts(spark, orders, bars, index):
    o = spark.createDataFrame(orders, "portfolio_id string, code string, trade_date date, side string, order_status string, executed_notional double, executed_units double")
    b = spark.createDataFrame(bars, "code string, trade_date date, close double")
    m = spark.createDataFrame(index, "trade_date date, close double")
    key = ["portfolio_id", "code"]
    valued = po.stale_valuation(po.position_ledger(o, key), b, m, key, "code")
    scenarios = spark.createDataFrame([(n, r, n == "LOW") for n, r in RATES.items()], "cost_scenario string, commission_rate double, is_baseline boolean")
    fees = spark.createDataFrame([(DAY(0), DAY(20), 0.002)], "effective_from date, effective_to date, sell_rate double")
    capital = spark.createDataFrame([("P0", 10_000.0), ("P1", 20_000.0)], "portfolio_id string, initial_capital double")
    return po.account_daily(o, valued, m, scenarios, fees, capital)


def test_accounts_equal_a_loop_over_days(spark):
    orders, bars, index = _fixture(spark)
    got = {(r.portfolio_id, r.cost_scenario, r.trade_date): r for r in _accounts(spark, orders, bars, index).collect()}
    seen = 0
    for portfolio, capital in (("P0", 10_000.0), ("P1", 20_000.0)):
        own = [o for o in orders if o[0] == portfolio]
        first = min(o[2] for o in own)
        for scenario, rate in RATES.items():
            cash, units, before, nav_before, top, base = capital, dict.fromkeys("abc", 0.0), capital, None, 0.0, None
            for day, level in index:
                if day < first:
                    continue
                base = base or level
                traded = cost = 0.0
                for o in (o for o in own if o[2] == day):
                    sign = 1 if o[3] == "BUY" else -1
                    fee = o[5] * rate + (o[5] * 0.002 if sign < 0 and day <= DAY(20) else 0.0)
                    cash, traded, cost = cash - sign * o[5] - fee, traded + o[5], cost + fee
                    units[o[1]] += sign * o[6]
                value = stale = oldest = 0
                for c, n in units.items():
                    price = max(((b[1], b[2]) for b in bars if b[0] == c and b[1] <= day), default=None)
                    if n > 0 and price:
                        value += n * price[1]
                        stale += n * price[1] if price[0] < day else 0.0
                        oldest = max(oldest, (day - price[0]).days)
                nav = cash + value
                top = max(top, nav)
                r = got[portfolio, scenario, day]
                seen += 1
                want = (cash, value, nav, traded / before, cost, stale / nav, cash / nav, nav / top - 1, level / base, (nav / nav_before - 1) if nav_before else 0.0)
                have = (r.cash, r.market_value, r.total_nav, r.turnover_ratio, r.total_trading_cost, r.stale_weight, r.cash_weight, r.strategy_drawdown, r.benchmark_nav, r.strategy_daily_return)
                assert have == pytest.approx(want) and r.maximum_stale_calendar_days == oldest
                before = nav_before = nav
    assert seen == len(got)


def test_account_summaries_add_up(spark):
    orders, bars, index = _fixture(spark)
    accounts = _accounts(spark, orders, bars, index)
    days = accounts.collect()
    for r in pf.account_performance(accounts).collect():
        own = sorted((d for d in days if (d.portfolio_id, d.cost_scenario) == (r.portfolio_id, r.cost_scenario)), key=lambda d: d.trade_date)
        assert r.trading_days == len(own) and r.strategy_total_return == pytest.approx(own[-1].strategy_nav - 1)
        assert r.cumulative_two_way_turnover == pytest.approx(sum(d.turnover_ratio for d in own))
        assert r.total_trading_cost_share == pytest.approx(sum(d.total_trading_cost for d in own) / own[0].initial_capital)
        assert r.failed_buy_orders + r.failed_sell_orders == sum(o[0] == r.portfolio_id and o[4] == "FAILED" for o in orders)
        assert r.terminal_stale_weight == pytest.approx(own[-1].stale_weight)
    months = pf.account_monthly(accounts).collect()
    assert sum(m.turnover for m in months) == pytest.approx(sum(d.turnover_ratio for d in days))
    assert sum(m.trading_days for m in months) == len(days)


def test_accounts_of_no_orders(spark):
    orders, bars, index = _fixture(spark)
    o = spark.createDataFrame([], "portfolio_id string, code string, trade_date date, side string, order_status string, executed_notional double, executed_units double")
    out = _accounts(spark, [("P0", "a", DAY(500), "BUY", "FILLED", 1.0, 1.0)], bars, index)
    assert out.count() == 0 and po.position_ledger(o, ["portfolio_id", "code"]).count() == 0


def test_experiments_at_other_costs(spark):
    selected = spark.createDataFrame([("BASELINE", DAY(m * 30), c) for m in range(3) for c in "ab"] + [("OTHER", DAY(0), "a")], "experiment_id string, signal_date date, canonical_ts_code string")
    more = rb.at_other_costs(selected, "BASELINE", ["CHEAP", "DEAR"])
    assert {r.experiment_id: r["count"] for r in more.groupBy("experiment_id").count().collect()} == {"BASELINE": 6, "OTHER": 1, "CHEAP": 6, "DEAR": 6}
    nav = spark.createDataFrame([("BASELINE", DAY(0), 1.0, 1.2), ("BASELINE", DAY(40), 0.5, 0.9), ("OTHER", DAY(0), 1.0, 0.8)], "experiment_id string, trade_date date, turnover double, nav_at_end double")
    rows = {r.experiment_id: r for r in rb.experiment_registry(more, nav, F.lit(0.01)).collect()}
    assert rows["BASELINE"].maximum_drawdown == pytest.approx(0.9 / 1.2 - 1) and rows["BASELINE"].trading_cost_share == pytest.approx(0.015)
    assert rows["OTHER"].maximum_drawdown == pytest.approx(-0.2) and rows["OTHER"].annualized_log_return is None
    assert rows["CHEAP"].log_total_return is None and rows["CHEAP"].signal_months == 3
