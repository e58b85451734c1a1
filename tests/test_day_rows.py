"""Rows by position and day are made last: no step shuffles, sorts or stores them."""

import datetime as dt
import os

import pytest

from factorloom.operators import portfolio as po
from factorloom.operators import quality as qa
from factorloom.plans.panels import panels

SF = "/root/testdata/sf0.001"
LEDGER, BARS = "portfolio_id string, code string, trade_date date, units_after double", "code string, trade_date date, close double"


def _d(n):
    return dt.date(2000, 1, 1) + dt.timedelta(n)


def _ledger(spark, rows):
    return spark.createDataFrame([("P", c, _d(n), u) for c, n, u in rows], LEDGER)


def _bars(spark, rows):
    return spark.createDataFrame([(c, _d(n), x) for c, n, x in rows], BARS)


def _above_days(df):
    """Steps of the executed plan from the making of days on, which come before it in the text."""
    text = df._jdf.queryExecution().executedPlan().toString()
    at = text.index("Generate explode(sequence(")
    return [line for line in text[:at].splitlines() if "Sort [" in line or "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_day_rows_are_neither_shuffled_nor_sorted(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert _above_days(panels(spark, SF).stale) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_valuation_is_not_written(spark):
    p = panels(spark, SF)
    p.accounts.count()
    p.stale.count()
    assert not [f for f in os.listdir(p.folder) if f.startswith("stale-")]


def _reconcile(spark, old, new, days=12):
    sides = [(_ledger(spark, ledger), po.closes(_bars(spark, bars), "code")) for ledger, bars in (old, new)]
    market = spark.createDataFrame([(_d(n),) for n in range(days)], "trade_date date")
    return qa.reconciled_holdings(*sides, market, ["portfolio_id", "code"], "code", 1e-6), sides, market


@pytest.mark.parametrize(
    "change",
    [
        lambda ledger, bars: (ledger, bars),
        lambda ledger, bars: ([*ledger, ("a", 6, 4.0)], bars),
        lambda ledger, bars: (ledger[:-1], bars),
        lambda ledger, bars: (ledger, [*bars, ("a", 4, 10.5)]),
        lambda ledger, bars: (ledger, bars[1:]),
        lambda ledger, bars: ([*ledger, ("d", 2, 1.0)], [*bars, ("b", 30, 2.0)]),
    ],
)
def test_holdings_side_by_side_agree_with_a_join_of_days(spark, change):
    old = [("a", 1, 5.0), ("a", 8, 0.0), ("b", 3, 2.0), ("c", 4, 1.0)], [("a", 0, 10.0), ("a", 5, 11.0), ("b", 4, 7.0)]
    got, sides, market = _reconcile(spark, old, change(*map(list, old)))
    key = ["portfolio_id", "code"]
    days = [po.valued_days(ledger, prices, market, key, "code") for ledger, prices in sides]
    want = qa.prefix_reconcile(*days, [*key, "trade_date"], ["price_source", "stale_calendar_days"], ["units", "price", "market_value"], 1e-6)
    assert got.first().asDict() == want.first().asDict()


def test_summary_by_brute_force(spark):
    rows = [("P", c, _d(n), age, value) for c, line in {"a": [(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0), (3, 0, 4.0), (5, 2, 5.0)], "b": [(2, 2, 7.0), (5, 0, 8.0)], "c": [(0, 0, 1.0)], "d": [(1, 900, 2.0), (3, 902, 6.0)]}.items() for n, age, value in line]
    valued = spark.createDataFrame(rows, "portfolio_id string, code string, trade_date date, stale_calendar_days int, market_value double")
    nav = spark.createDataFrame([("P", _d(5), 50.0)], "portfolio_id string, trade_date date, total_nav double")
    got = {r.code: tuple(r)[2:] for r in po.stale_summary(valued, ["portfolio_id", "code"], nav).collect()}
    assert got == {
        "a": (_d(1), _d(5), 3, 2, _d(2), _d(3), True, 5.0, 0.1),
        "b": (_d(2), _d(2), 1, 2, _d(2), _d(0), False, None, None),
        "d": (_d(1), _d(3), 2, 902, _d(3), _d(-899), False, None, None),
    }
