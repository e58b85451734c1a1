"""Bindings: the test tables in the shapes that panel operators read.

Each text runs unchanged on Spark SQL and DuckDB. An entity is a supplier, a bar a supplier's
day of shipments, a portfolio scenario an order status.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BINDINGS = {
    # daily bars (key ts_code, trade_date); dates 1995-01-02 .. 2001-11-04
    "b_daily": """
SELECT concat(lpad(CAST(l_suppkey AS STRING), 6, '0'), '.',
              CASE WHEN l_suppkey % 10 = 9 THEN 'BJ' WHEN l_suppkey % 2 = 0 THEN 'SH' ELSE 'SZ' END) AS ts_code,
       l_suppkey AS suppkey,
       CAST(l_shipdate AS DATE) AS trade_date,
       avg(l_extendedprice / l_quantity) AS open,
       max(l_extendedprice / l_quantity) AS high,
       min(l_extendedprice / l_quantity) AS low,
       sum(l_extendedprice) / sum(l_quantity) AS close,
       sum(l_quantity) AS vol,
       sum(l_extendedprice) AS amount,
       avg(l_discount) AS avg_discount
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
""",
    # adjustment factor (key ts_code, trade_date)
    "b_adj": """
SELECT ts_code, trade_date, 1.0E0 + 0.01E0 * (year(trade_date) - 1995) AS adj_factor FROM b_daily
""",
    # calendar with closed days
    "b_trade_cal": """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS cal_date,
       CASE WHEN day(CAST(l_shipdate AS DATE)) % 7 = 0 THEN 0 ELSE 1 END AS is_open FROM lineitem
""",
    # two code changes, suppliers 1->2 and 3->4
    "b_code_history": """
SELECT o.ts_code AS old_ts_code, n.ts_code AS new_ts_code, n.ts_code AS canonical_ts_code,
       CASE WHEN o.suppkey = 1 THEN DATE '1998-06-01' ELSE DATE '1999-03-01' END AS effective_date,
       DATE '1995-06-01' AS original_list_date
FROM (SELECT DISTINCT ts_code, suppkey FROM b_daily) o
JOIN (SELECT DISTINCT ts_code, suppkey FROM b_daily) n ON n.suppkey = o.suppkey + 1
WHERE o.suppkey IN (1, 3)
""",
    # listing dates; supplier 1 has no record, every 4th is older than the calendar, every 11th is delisted
    "b_stock_basic": """
SELECT DISTINCT ts_code,
       CASE WHEN suppkey % 4 = 0 THEN DATE '1994-06-01' ELSE DATE '1996-01-01' END AS list_date,
       CASE WHEN suppkey % 11 = 0 THEN DATE '2000-06-30' END AS delist_date
FROM b_daily WHERE suppkey <> 1
""",
    # closed/closed yearly intervals, last one open
    "b_industry_history": """
SELECT c.ts_code, concat('IND', CAST((s.s_nationkey + y.yr) % 7 AS STRING)) AS industry_code,
       y.effective_from, y.effective_to
FROM (SELECT DISTINCT ts_code, suppkey FROM b_daily) c
JOIN supplier s ON s.s_suppkey = c.suppkey
CROSS JOIN (SELECT 1995 AS yr, DATE '1995-01-01' AS effective_from, DATE '1995-12-31' AS effective_to
  UNION ALL SELECT 1996, DATE '1996-01-01', DATE '1997-12-31'
  UNION ALL SELECT 1998, DATE '1998-01-01', DATE '1999-06-30'
  UNION ALL SELECT 1999, DATE '1999-07-01', CAST(NULL AS DATE)) y
""",
    # names with an occasional ST prefix
    "b_name_history": """
SELECT c.ts_code, CASE WHEN (c.suppkey + y.yr) % 13 = 0 THEN concat('ST ', s.s_name) ELSE upper(substr(s.s_name, 10)) END AS stock_name,
       y.effective_from, y.effective_to
FROM (SELECT DISTINCT ts_code, suppkey FROM b_daily) c
JOIN supplier s ON s.s_suppkey = c.suppkey
CROSS JOIN (SELECT 1995 AS yr, DATE '1995-01-01' AS effective_from, DATE '1998-03-31' AS effective_to
  UNION ALL SELECT 1998, DATE '1998-04-01', CAST(NULL AS DATE)) y
""",
    # price limits around the previous close (key ts_code, trade_date)
    "b_limit": """
SELECT ts_code, trade_date, floor(pre_close * 2.0E2 + 0.4863E0) / 1.0E2 AS up_limit, floor(pre_close * 0.5E2 + 0.4863E0) / 1.0E2 AS down_limit
FROM (SELECT ts_code, trade_date, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close FROM b_daily) x
WHERE pre_close IS NOT NULL
""",
    # suspension/resumption events moved from 2024-01 to 1999-01, suppliers 0..9
    "b_suspend": """
SELECT d.ts_code, CAST(CAST(e.ts AS DATE) - INTERVAL '9131' DAY AS DATE) AS trade_date,
       CASE WHEN e.event_type = 'signup' THEN 'R' ELSE 'S' END AS suspend_type,
       CASE WHEN e.event_type = 'click' AND e.event_id % 3 = 0 THEN '09:00-10:00,13:00-14:00'
            WHEN e.event_type = 'click' THEN '13:00-15:00' ELSE '' END AS suspend_timing
FROM events e JOIN (SELECT DISTINCT ts_code, suppkey FROM b_daily) d ON d.suppkey = e.user_id % 10
WHERE e.event_type IN ('error', 'signup', 'click') AND e.event_id % 40 < 3
""",
    # last bar per entity and month = month-end row (key ts_code, signal_date)
    "b_month_end": """
SELECT ts_code, suppkey, signal_date, trade_date AS asof_trade_date,
       (avg_discount - 0.01E0) * 40.0E0 AS pb, month_amount / 10000.0E0 AS total_mv
FROM (SELECT d.*, last_day(trade_date) AS signal_date,
             sum(amount) OVER (PARTITION BY ts_code, last_day(trade_date)) AS month_amount,
             row_number() OVER (PARTITION BY ts_code, last_day(trade_date) ORDER BY trade_date DESC) AS rn
      FROM b_daily d) x
WHERE rn = 1
""",
    # one index level per day
    "b_benchmark": """
SELECT 'IDX' AS benchmark_code, trade_date, sum(amount) / sum(vol) AS close FROM b_daily GROUP BY trade_date
""",
    # cost scenarios
    "b_scenarios": """
SELECT 'STRESS_5BPS' AS cost_scenario, 0.0005E0 AS commission_rate, false AS is_baseline
UNION ALL SELECT 'BASE_10BPS', 0.001E0, true UNION ALL SELECT 'STRESS_20BPS', 0.002E0, false
""",
    # sell-side tax regimes, closed/closed
    "b_fees": """
SELECT DATE '1995-01-01' AS effective_from, DATE '1998-12-31' AS effective_to, 0.001E0 AS sell_rate
UNION ALL SELECT DATE '1999-01-01', DATE '2001-12-31', 0.0005E0
""",
    # order/fill ledger, five portfolios; total order = (trade_date, orderkey, linenumber, partkey, suppkey)
    "b_orders": """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,
       concat('P', CAST(o_custkey % 5 AS STRING)) AS portfolio_id,
       l_suppkey AS suppkey, CAST(l_shipdate AS DATE) AS trade_date,
       CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
       CASE WHEN l_tax > 0.075E0 THEN 'FAILED' WHEN l_tax > 0.065E0 THEN 'PARTIAL_CASH_CONSTRAINT' ELSE 'FILLED' END AS order_status,
       CASE WHEN l_tax <= 0.075E0 THEN '' WHEN l_linestatus = 'F' THEN 'SUSPENDED_AT_OPEN' ELSE 'NO_OPEN_PRICE' END AS failure_reason,
       l_extendedprice AS desired_notional,
       CASE WHEN l_tax > 0.075E0 THEN 0.0E0 ELSE l_extendedprice END AS executed_notional,
       CASE WHEN l_tax > 0.075E0 THEN 0.0E0 ELSE l_quantity END AS executed_units
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    # daily strategy and benchmark returns per scenario (F/O/P)
    "b_returns": """
SELECT s.o_orderstatus AS cost_scenario, s.trade_date, s.strategy_daily_return, b.benchmark_daily_return
FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS trade_date,
             (avg(o_totalprice) - 250000.0E0) / 1.0E7 AS strategy_daily_return
      FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)) s
JOIN (SELECT CAST(o_orderdate AS DATE) AS trade_date, (avg(o_totalprice) - 250000.0E0) / 1.0E7 AS benchmark_daily_return
      FROM orders GROUP BY CAST(o_orderdate AS DATE)) b ON b.trade_date = s.trade_date
""",
}


def used(sql: str) -> list[str]:
    """Tables and bindings that a text names."""
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", sql)))
    return [n for n in (*TABLES, *BINDINGS) if n in words]


#: Bindings that are written once, as most others start from them; the bars in buckets of the code. The
#: orders keep the order of lineitem where a join broadcasts, so that sums of money meet the same last bits.
WRITTEN, BY_CODE = {"b_month_end", "b_benchmark", "b_orders"}, {"b_daily"}

#: The bars' own frame on Spark: what the text of b_daily gives, dealt by the code before the days are
#: summed, as nearly every row of lineitem is a supplier's only one of its day.
_CODE = "concat(lpad(CAST(l_suppkey AS STRING), 6, '0'), '.', CASE WHEN l_suppkey % 10 = 9 THEN 'BJ' WHEN l_suppkey % 2 = 0 THEN 'SH' ELSE 'SZ' END)"
_SUMS = ("avg(price / quantity) AS open", "max(price / quantity) AS high", "min(price / quantity) AS low", "sum(price) / sum(quantity) AS close", "sum(quantity) AS vol", "sum(price) AS amount", "avg(discount) AS avg_discount")


def bars_of(lineitem: DataFrame, n: int) -> DataFrame:
    """b_daily in n partitions of the code, with one exchange."""
    rows = lineitem.selectExpr(f"{_CODE} AS ts_code", "l_suppkey AS suppkey", "CAST(l_shipdate AS DATE) AS trade_date", "l_extendedprice AS price", "l_quantity AS quantity", "l_discount AS discount")
    return rows.repartition(n, "ts_code").groupBy("ts_code", "suppkey", "trade_date").agg(*map(F.expr, _SUMS))


Keep = Callable[..., DataFrame]


def bound(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame], keep: Keep, by_code: Keep, n: int) -> DataFrame:
    """A table or binding as a DataFrame; made holds those of earlier calls for the same inputs,
    keep and by_code write one and read it back, the latter in n buckets."""
    if name not in made:
        made[name] = _bind(spark, sf_dir, name, made, keep, by_code, n)
    return made[name]


def _bind(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame], keep: Keep, by_code: Keep, n: int) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    of = lambda table: bound(spark, sf_dir, table, made, keep, by_code, n)
    if name in BY_CODE:
        return by_code(bars_of(of("lineitem"), n), name, dealt=True)
    inputs = used(BINDINGS[name])
    if not inputs:
        return spark.sql(BINDINGS[name])
    df = spark.sql(re.sub(rf"\b({'|'.join(inputs)})\b", r"{\1}", BINDINGS[name]), **{t: of(t) for t in inputs})
    return keep(df, name) if name in WRITTEN else df


def with_bindings(sql: str) -> str:
    """The text behind a WITH clause of the bindings it names, in order of definition."""
    needed, todo = set(), [n for n in used(sql) if n in BINDINGS]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in used(BINDINGS[n]) if m in BINDINGS]
    parts = [f"{n} AS ({BINDINGS[n]})" for n in BINDINGS if n in needed]
    return f"WITH {', '.join(parts)} SELECT * FROM ({sql}) AS q" if parts else sql
