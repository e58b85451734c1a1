"""Stale valuation over all market days, against brute force."""

import datetime as dt

import duckdb

from factorloom.operators import portfolio as po
from factorloom.plans import registry
from factorloom.sources.bindings import TABLES

SF = "/root/testdata/sf0.001"


def test_positions_count_from_their_first_fill(spark):
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    fills = [(1, "a", 3, 5.0), (1, "a", 9, 0.0), (1, "a", 12, 2.0), (2, "a", 0, 1.0), (2, "b", 14, 4.0), (3, "c", 5, 1.0)]
    bars = [("a", 1, 10.0), ("a", 4, 11.0), ("a", 13, 12.0), ("b", 10, 7.0)]
    market = [2, 3, 4, 6, 8, 9, 10, 13, 14, 16]
    want = set()
    for key in {f[:2] for f in fills}:
        for d in market:
            units = [f[3] for f in fills if f[:2] == key and f[2] <= d][-1:]
            price = [b[1:] for b in bars if b[0] == key[1] and b[1] <= d][-1:]
            if units and units[0] > 0:
                want.add((*key, day(d), units[0], price[0][1] if price else None, d - price[0][0] if price else None))
    ledger = spark.createDataFrame([(p, c, day(d), u) for p, c, d, u in fills], "portfolio_id long, code string, trade_date date, units_after double")
    prices = spark.createDataFrame([(c, day(d), x) for c, d, x in bars], "code string, trade_date date, close double")
    out = po.stale_valuation(ledger, prices, spark.createDataFrame([(day(d),) for d in market], "trade_date date"), ["portfolio_id", "code"], "code")
    rows = out.collect()
    assert {(r.portfolio_id, r.code, r.trade_date, r.units, r.price, r.stale_calendar_days) for r in rows} == want and len(rows) == len(want)


def test_registered_query_has_all_market_days(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = registry.oracle_sql()["stale_valuation"]
    want = con.sql(f"SELECT count(*), min(trade_date), max(trade_date), sum(stale_calendar_days)::BIGINT, round(sum(market_value)) FROM ({sql})").fetchall()[0]
    days = con.sql("SELECT min(l_shipdate)::DATE, max(l_shipdate)::DATE FROM lineitem").fetchall()[0]
    for name in ("stale_valuation", "stale_valuation_all_days"):
        got = registry.queries()[name](spark, SF).selectExpr("count(*)", "min(trade_date)", "max(trade_date)", "sum(stale_calendar_days)", "round(sum(market_value))").first()
        assert tuple(got)[:4] == want[:4] and abs(got[4] - want[4]) <= 1e-9 * abs(want[4])
        assert got[1] >= days[0] and got[2] == days[1]
