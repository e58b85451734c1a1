"""Registered queries: portfolio, performance and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import factors as fc
from factorloom.operators import performance as pf
from factorloom.operators import portfolio as po
from factorloom.operators import quality as qa
from factorloom.operators import robustness as rb
from factorloom.operators.factors import FactorRules
from factorloom.plans.panels import Panels
from factorloom.plans.registry import KEY, PERIOD_SQL, PERIODS, plan
from factorloom.plans.twins import FACTORS, PANELS

RATIO = 1.25
BASE_COST, COSTS = 0.001, {"COST_5BPS": 0.0005, "COST_20BPS": 0.002}
_ALL = "strategy", "benchmark"


def _score(z: str = "{}_z") -> str:
    return "round(0.0::DOUBLE + " + " + ".join(f"{z.format(f)} * {1 / 3!r}::DOUBLE" for f in FACTORS) + ", 9)"


def _topn(source: str, where: str = "universe_eligible") -> str:
    return f"SELECT canonical_ts_code, signal_date, composite_score, selection_rank, least(1.0::DOUBLE / count(*) OVER (PARTITION BY signal_date), 0.02::DOUBLE) AS target_weight FROM (SELECT canonical_ts_code, signal_date, {_score()} AS composite_score, row_number() OVER (PARTITION BY signal_date ORDER BY {_score()} DESC NULLS LAST, canonical_ts_code)::INT AS selection_rank FROM {source} WHERE {where}) WHERE selection_rank <= 20"


PANELS |= {
    "t_targets": _topn("t_panel"),
    "t_schedule": "SELECT s.signal_date, min(b.trade_date) AS scheduled_trade_date, CASE WHEN min(b.trade_date) IS NULL THEN 'OUT_OF_SCOPE_NOT_EXECUTED' ELSE 'SCHEDULED_WITHIN_RESEARCH' END AS schedule_status FROM (SELECT DISTINCT signal_date FROM t_month) s LEFT JOIN b_benchmark b ON b.trade_date > s.signal_date GROUP BY s.signal_date",
    "t_costs": "SELECT o.*, s.*, f.sell_rate, executed_notional * commission_rate AS commission_cost, CASE WHEN side = 'SELL' THEN executed_notional * sell_rate ELSE 0.0::DOUBLE END AS stamp_duty_cost FROM b_orders o CROSS JOIN b_scenarios s LEFT JOIN b_fees f ON o.trade_date BETWEEN f.effective_from AND f.effective_to",
    "t_ledger": "SELECT portfolio_id, suppkey, trade_date, u AS units_traded, sum(u) OVER (PARTITION BY portfolio_id, suppkey ORDER BY trade_date) AS units_after FROM (SELECT portfolio_id, suppkey, trade_date, sum(CASE WHEN side = 'BUY' THEN executed_units ELSE -executed_units END) AS u FROM b_orders GROUP BY ALL)",
    "t_days": "SELECT DISTINCT s.scheduled_trade_date AS trade_date FROM t_schedule s JOIN t_targets t USING (signal_date) WHERE s.scheduled_trade_date IS NOT NULL",
    "t_wanted": """SELECT s.scheduled_trade_date AS trade_date, c.suppkey, t.target_weight FROM t_targets t JOIN t_schedule s USING (signal_date)
        JOIN (SELECT DISTINCT ts_code, suppkey FROM b_daily) c ON c.ts_code = t.canonical_ts_code WHERE s.scheduled_trade_date IS NOT NULL""",
    "t_held": """SELECT l.portfolio_id, l.suppkey, d.trade_date, max_by(l.units_after, l.trade_date) AS units FROM t_ledger l JOIN t_days d ON l.trade_date < d.trade_date
        GROUP BY ALL HAVING max_by(l.units_after, l.trade_date) > 1e-12""",
    "t_priced": """SELECT h.*, coalesce(o.open, c.close) AS price FROM t_held h LEFT JOIN (SELECT suppkey, trade_date, open FROM b_daily WHERE open > 0) o USING (suppkey, trade_date)
        LEFT JOIN (SELECT d.trade_date, b.suppkey, max_by(b.close, b.trade_date) AS close FROM t_days d JOIN b_daily b ON b.trade_date < d.trade_date GROUP BY ALL) c USING (suppkey, trade_date)""",
    "t_marks": "SELECT l.portfolio_id, l.suppkey, b.trade_date FROM (SELECT portfolio_id, suppkey, min(trade_date) AS first FROM t_ledger GROUP BY ALL) l JOIN b_benchmark b ON b.trade_date >= l.first",
    "t_stale": """SELECT portfolio_id, suppkey, trade_date, units, price, CASE WHEN pd = trade_date THEN 'CLOSE' WHEN pd IS NOT NULL THEN 'STALE_CLOSE' END AS price_source, (trade_date - pd)::INT AS stale_calendar_days, units * price AS market_value FROM (
        SELECT m.*, l.units_after AS units, d.close AS price, d.trade_date AS pd FROM t_marks m ASOF LEFT JOIN t_ledger l ON l.portfolio_id = m.portfolio_id AND l.suppkey = m.suppkey AND l.trade_date <= m.trade_date
        ASOF LEFT JOIN b_daily d ON d.suppkey = m.suppkey AND d.trade_date <= m.trade_date) WHERE units > 1e-12""",
    "t_refs": f"""SELECT h.old_ts_code, h.new_ts_code, h.effective_date, o.trade_date AS old_last_date, o.close AS old_close, o.adj_factor AS old_factor, n.trade_date AS successor_first_date, n.open AS successor_open, n.adj_factor AS successor_factor, {RATIO}::DOUBLE AS conversion_ratio,
        abs(o.close * o.adj_factor - o.close_hfq) <= 1e-8 AND abs(n.open * n.adj_factor - n.open_hfq) <= 1e-8 AS is_consistent FROM b_code_history h
        JOIN t_daily o ON o.ts_code = h.old_ts_code AND o.trade_date = (SELECT max(trade_date) FROM t_daily d WHERE d.ts_code = h.old_ts_code AND d.trade_date < h.effective_date)
        JOIN t_daily n ON n.ts_code = h.new_ts_code AND n.trade_date = (SELECT min(trade_date) FROM t_daily d WHERE d.ts_code = h.new_ts_code AND d.trade_date >= h.effective_date AND d.open > 0)""",
    "t_nav0": "SELECT cost_scenario, trade_date, CASE WHEN row_number() OVER w = 1 THEN 0.0::DOUBLE ELSE strategy_daily_return END AS strategy, CASE WHEN row_number() OVER w = 1 THEN 0.0::DOUBLE ELSE benchmark_daily_return END AS benchmark FROM b_returns WINDOW w AS (PARTITION BY cost_scenario ORDER BY trade_date)",
    "t_nav1": "SELECT *, product(1 + strategy) OVER w AS strategy_nav, product(1 + benchmark) OVER w AS benchmark_nav FROM t_nav0 WINDOW w AS (PARTITION BY cost_scenario ORDER BY trade_date)",
    "t_nav": "SELECT cost_scenario, trade_date, strategy AS strategy_daily_return, benchmark AS benchmark_daily_return, strategy_nav, benchmark_nav, strategy_nav / max(strategy_nav) OVER w - 1 AS strategy_drawdown, benchmark_nav / max(benchmark_nav) OVER w - 1 AS benchmark_drawdown, strategy_nav / benchmark_nav AS relative_nav FROM t_nav1 WINDOW w AS (PARTITION BY cost_scenario ORDER BY trade_date)",
}


def _grouped(source: str, by: str) -> str:
    paths = f"SELECT *, product(1 + strategy_daily_return) OVER w AS sp, product(1 + benchmark_daily_return) OVER w AS bp FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY trade_date)"
    falls = f"SELECT *, sp / max(sp) OVER w - 1 AS sf, bp / max(bp) OVER w - 1 AS bf, strategy_daily_return - benchmark_daily_return AS x FROM ({paths}) WINDOW w AS (PARTITION BY {by} ORDER BY trade_date)"
    return f"""SELECT *, pow(1 + strategy_total_return, 1 / (trading_days / 252)) - 1 AS strategy_annualized_return, pow(1 + benchmark_total_return, 1 / (trading_days / 252)) - 1 AS benchmark_annualized_return, (1 + strategy_total_return) / (1 + benchmark_total_return) AS terminal_relative_nav FROM (
      SELECT {by}, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS trading_days, max_by(sp, trade_date) - 1 AS strategy_total_return, max_by(bp, trade_date) - 1 AS benchmark_total_return, stddev_samp(strategy_daily_return) * sqrt(252) AS strategy_annualized_volatility,
        stddev_samp(benchmark_daily_return) * sqrt(252) AS benchmark_annualized_volatility, min(sf) AS strategy_max_drawdown, min(bf) AS benchmark_max_drawdown, CASE WHEN stddev_samp(strategy_daily_return) > 0 THEN avg(strategy_daily_return) / stddev_samp(strategy_daily_return) * sqrt(252) END AS strategy_sharpe_zero_rf,
        stddev_samp(x) * sqrt(252) AS tracking_error_annualized, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(252) END AS information_ratio FROM ({falls}) GROUP BY {by})"""


def _drifting(targets: str, cost: str, by: str = "") -> str:
    """drift_nav in SQL; by: key columns, each followed by a comma."""
    keys = [k.strip() for k in by.split(",") if k.strip()]
    over = f"PARTITION BY {', '.join(keys)} ORDER BY leg" if keys else "ORDER BY leg"
    bars = "(SELECT canonical_ts_code AS c, trade_date AS d, close_hfq AS p FROM t_daily WHERE security_code_interval_valid AND close_hfq IS NOT NULL)"
    legs = "(SELECT signal_date, scheduled_trade_date AS b, lead(scheduled_trade_date) OVER (ORDER BY scheduled_trade_date) AS e, row_number() OVER (ORDER BY scheduled_trade_date) AS leg FROM t_schedule WHERE scheduled_trade_date IS NOT NULL)"
    held = f"SELECT {by} t.canonical_ts_code AS code, signal_date, b, e, leg, target_weight AS w FROM {targets} t JOIN {legs} USING (signal_date)"
    priced = f"SELECT h.*, w * coalesce(y.p / x.p, 1) AS grown FROM ({held}) h ASOF LEFT JOIN {bars} x ON x.c = h.code AND x.d <= h.b ASOF LEFT JOIN {bars} y ON y.c = h.code AND y.d <= coalesce(h.e, DATE '0001-01-01')"
    sums = f"SELECT *, sum(grown) OVER g + 1 - sum(w) OVER g AS growth FROM ({priced}) WINDOW g AS (PARTITION BY {by} leg)"
    moves = f"SELECT {by} leg, code, sum(w) - sum(old) AS change FROM (SELECT {by} leg, code, w, 0 AS old FROM r UNION ALL SELECT {by} leg + 1, code, 0, grown / growth FROM r) GROUP BY {by} leg, code"
    return f"""SELECT *, product((1 - {cost} * turnover) * coalesce(growth, 1)) OVER (w ROWS UNBOUNDED PRECEDING) AS nav_at_end FROM (
      WITH r AS ({sums}) SELECT {by} signal_date, b AS trade_date, leg, turnover, CASE WHEN e IS NOT NULL THEN growth END AS growth
      FROM (SELECT DISTINCT {by} signal_date, b, e, leg, first_value(growth) OVER (PARTITION BY {by} leg ORDER BY code) AS growth FROM r) JOIN (SELECT {by} leg, sum(abs(change)) AS turnover FROM ({moves}) GROUP BY {by} leg) USING ({by} leg)) WINDOW w AS ({over})"""


def _flow(side: str) -> str:
    return f"sum(CASE WHEN side {side} 'BUY' THEN executed_notional ELSE 0 END)"


def _count(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


_w = "(PARTITION BY portfolio_id, cost_scenario ORDER BY trade_date)"
PANELS |= {
    "t_flow": f"""SELECT portfolio_id, trade_date, {_flow('=')} AS executed_buy_notional, {_flow('<>')} AS executed_sell_notional, {_count("order_status = 'FAILED' AND side = 'BUY'")} AS failed_buy_orders,
      {_count("order_status = 'FAILED' AND side <> 'BUY'")} AS failed_sell_orders, {_count("order_status = 'PARTIAL_CASH_CONSTRAINT'")} AS partial_order_count FROM b_orders GROUP BY ALL""",
    "t_capital": f"SELECT portfolio_id, {_flow('=')} * 1.1::DOUBLE + 1 AS initial_capital, min(trade_date) AS first_day FROM b_orders GROUP BY portfolio_id",
    "t_mark": f"""SELECT portfolio_id, trade_date, sum(market_value) AS market_value, count(*) AS holding_count, {_count("stale_calendar_days > 0")} AS stale_position_count,
      sum(CASE WHEN stale_calendar_days > 0 THEN market_value ELSE 0 END) AS stale_market_value, max(stale_calendar_days) AS maximum_stale_calendar_days FROM t_stale GROUP BY ALL""",
    "t_acc0": """SELECT c.portfolio_id, s.cost_scenario, s.is_baseline, m.trade_date, m.close AS benchmark_close, c.initial_capital, coalesce(executed_buy_notional, 0) AS executed_buy_notional, coalesce(executed_sell_notional, 0) AS executed_sell_notional,
      coalesce(failed_buy_orders, 0) AS failed_buy_orders, coalesce(failed_sell_orders, 0) AS failed_sell_orders, coalesce(partial_order_count, 0) AS partial_order_count, coalesce(market_value, 0) AS market_value, coalesce(holding_count, 0) AS holding_count,
      coalesce(stale_position_count, 0) AS stale_position_count, coalesce(stale_market_value, 0) AS stale_market_value, coalesce(maximum_stale_calendar_days, 0) AS maximum_stale_calendar_days,
      (coalesce(executed_buy_notional, 0) + coalesce(executed_sell_notional, 0)) * s.commission_rate AS commission_cost, coalesce(executed_sell_notional, 0) * coalesce(f.sell_rate, 0) AS stamp_duty_cost
      FROM t_capital c JOIN b_benchmark m ON m.trade_date >= c.first_day CROSS JOIN b_scenarios s LEFT JOIN b_fees f ON m.trade_date BETWEEN f.effective_from AND f.effective_to
      LEFT JOIN t_flow x ON x.portfolio_id = c.portfolio_id AND x.trade_date = m.trade_date LEFT JOIN t_mark k ON k.portfolio_id = c.portfolio_id AND k.trade_date = m.trade_date""",
    "t_acc1": f"SELECT *, commission_cost + stamp_duty_cost AS total_trading_cost, initial_capital + sum(executed_sell_notional - executed_buy_notional - commission_cost - stamp_duty_cost) OVER {_w} AS cash FROM t_acc0",
    "t_acc2": f"SELECT *, cash + market_value AS total_nav, (cash + market_value) / initial_capital AS strategy_nav, benchmark_close / first_value(benchmark_close) OVER {_w} AS benchmark_nav, coalesce(lag(cash + market_value) OVER {_w}, initial_capital) AS nav_before FROM t_acc1",
    "t_acc": f"""SELECT *, coalesce(strategy_nav / lag(strategy_nav) OVER w - 1, 0) AS strategy_daily_return, coalesce(benchmark_nav / lag(benchmark_nav) OVER w - 1, 0) AS benchmark_daily_return, strategy_nav / max(strategy_nav) OVER w - 1 AS strategy_drawdown,
      benchmark_nav / max(benchmark_nav) OVER w - 1 AS benchmark_drawdown, strategy_nav / benchmark_nav AS relative_nav, CASE WHEN nav_before > 0 THEN (executed_buy_notional + executed_sell_notional) / nav_before ELSE 0 END AS turnover_ratio,
      CASE WHEN total_nav > 0 THEN cash / total_nav END AS cash_weight, CASE WHEN total_nav > 0 THEN market_value / total_nav END AS market_value_weight, CASE WHEN total_nav > 0 THEN stale_market_value / total_nav END AS stale_weight FROM t_acc2 WINDOW w AS {_w}""",
}
PANELS |= {
    "t_before": "SELECT d.trade_date, d.portfolio_id, d.cost_scenario, d.is_baseline, a.cash FROM (SELECT * FROM t_days CROSS JOIN (SELECT DISTINCT portfolio_id, cost_scenario, is_baseline FROM t_acc)) d ASOF JOIN t_acc a ON a.portfolio_id = d.portfolio_id AND a.cost_scenario = d.cost_scenario AND a.trade_date < d.trade_date",
    "t_valued": "SELECT p.*, units * price AS current_value, sum(units * price) OVER (PARTITION BY p.portfolio_id, p.trade_date) + b.cash AS pretrade_nav FROM t_priced p JOIN t_before b ON b.portfolio_id = p.portfolio_id AND b.trade_date = p.trade_date AND b.is_baseline",
    "t_orders": """SELECT portfolio_id, trade_date, suppkey, current_value, target_value, CASE WHEN target_value - current_value < -0.01 THEN 'SELL' ELSE 'BUY' END AS side, abs(target_value - current_value) AS desired_notional FROM (
        SELECT portfolio_id, trade_date, suppkey, coalesce(v.current_value, 0.0::DOUBLE) AS current_value, coalesce(w.target_value, 0.0::DOUBLE) AS target_value FROM (SELECT portfolio_id, trade_date, suppkey, current_value FROM t_valued) v FULL JOIN
        (SELECT n.portfolio_id, n.trade_date, t.suppkey, t.target_weight * n.nav AS target_value FROM t_wanted t JOIN (SELECT portfolio_id, trade_date, max(pretrade_nav) AS nav FROM t_valued GROUP BY ALL) n USING (trade_date)) w
        USING (portfolio_id, trade_date, suppkey)) WHERE abs(target_value - current_value) > 0.01""",
    "t_gated": """SELECT *, CASE WHEN failure_reason IS NOT NULL THEN 'FAILED' ELSE 'PLANNED' END AS order_status FROM (SELECT o.*, CASE WHEN e.suppkey IS NULL THEN 'NO_EXECUTION_STATUS'
        WHEN NOT has_daily_price THEN concat('NO_OPEN_PRICE', CASE WHEN suspended_at_open THEN '_SUSPENDED' ELSE '' END) WHEN suspended_at_open THEN 'SUSPENDED_AT_OPEN' WHEN side = 'BUY' AND open_at_up_limit THEN 'OPEN_AT_UP_LIMIT' WHEN side = 'SELL' AND open_at_down_limit THEN 'OPEN_AT_DOWN_LIMIT'
        WHEN CASE WHEN side = 'BUY' THEN cannot_buy_at_open ELSE cannot_sell_at_open END THEN 'OTHER_BLOCK' END AS failure_reason
        FROM t_orders o LEFT JOIN (SELECT x.*, c.suppkey FROM t_exec x JOIN (SELECT DISTINCT ts_code, suppkey FROM b_daily) c USING (ts_code)) e USING (suppkey, trade_date))""",
    "t_cash": """SELECT d.*, s.*, b.cash + sell_proceeds * (1 - commission_rate - coalesce(f.sell_rate, 0)) AS available_cash FROM (
        SELECT portfolio_id, trade_date, sum(CASE WHEN side = 'BUY' THEN desired_notional ELSE 0 END) AS total_buy_demand, count(*) FILTER (WHERE side = 'BUY') AS buy_orders,
          sum(CASE WHEN side = 'SELL' AND order_status = 'PLANNED' THEN desired_notional ELSE 0 END) AS sell_proceeds FROM t_gated GROUP BY ALL) d
        CROSS JOIN b_scenarios s JOIN t_before b ON b.portfolio_id = d.portfolio_id AND b.trade_date = d.trade_date AND b.cost_scenario = s.cost_scenario LEFT JOIN b_fees f ON d.trade_date BETWEEN f.effective_from AND f.effective_to""",
}


def _run_sql(source: str, by: str) -> str:
    """performance_summary in SQL."""
    return f"""SELECT *, pow(1 + strategy_total_return, 1 / greatest((trading_days - 1) / 252, 1 / 252)) - 1 AS strategy_annualized_return, pow(1 + benchmark_total_return, 1 / greatest((trading_days - 1) / 252, 1 / 252)) - 1 AS benchmark_annualized_return,
      pow(1 + strategy_total_return, 1 / greatest((trading_days - 1) / 252, 1 / 252)) - pow(1 + benchmark_total_return, 1 / greatest((trading_days - 1) / 252, 1 / 252)) AS annualized_return_difference FROM (
      SELECT {by}, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS trading_days, max_by(strategy_nav, trade_date) - 1 AS strategy_total_return, max_by(benchmark_nav, trade_date) - 1 AS benchmark_total_return, stddev_samp(r) * sqrt(252) AS strategy_annualized_volatility, stddev_samp(b) * sqrt(252) AS benchmark_annualized_volatility,
        CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) END AS strategy_sharpe_zero_rf, min(strategy_drawdown) AS strategy_max_drawdown, min(benchmark_drawdown) AS benchmark_max_drawdown, max_by(relative_nav, trade_date) AS terminal_relative_nav, stddev_samp(r - b) * sqrt(252) AS tracking_error_annualized,
        CASE WHEN stddev_samp(r - b) > 0 THEN avg(r - b) / stddev_samp(r - b) * sqrt(252) END AS information_ratio FROM (SELECT *, CASE WHEN rn > 1 THEN strategy_daily_return END AS r, CASE WHEN rn > 1 THEN benchmark_daily_return END AS b FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY trade_date) AS rn FROM {source})) GROUP BY {by})"""


_METRICS = "strategy_total_return benchmark_total_return strategy_annualized_volatility benchmark_annualized_volatility strategy_max_drawdown benchmark_max_drawdown strategy_sharpe_zero_rf tracking_error_annualized information_ratio strategy_annualized_return benchmark_annualized_return terminal_relative_nav"
PANELS |= {
    "t_period": _grouped(f"(SELECT r.*, p.period FROM b_returns r JOIN {PERIOD_SQL} ON r.trade_date BETWEEN p.a AND p.b)", "cost_scenario, period"),
    "t_period_acc": _grouped(f"(SELECT r.*, p.period FROM t_acc r JOIN {PERIOD_SQL} ON r.trade_date BETWEEN p.a AND p.b)", "portfolio_id, cost_scenario, period"),
    "t_annual": _grouped("(SELECT *, year(trade_date)::INT AS year FROM b_returns)", "cost_scenario, year"),
    "t_perf": _run_sql("t_nav", "cost_scenario"),
    "t_perf_acc": _run_sql("t_acc", "portfolio_id, cost_scenario"),
    "t_monthly": """SELECT cost_scenario, month, start_date, end_date, trading_days, strategy_return, benchmark_return, coalesce(failed_orders, 0) AS failed_orders, strategy_return - benchmark_return AS excess_return FROM (SELECT cost_scenario, strftime(trade_date, '%Y-%m') AS month, min(trade_date) AS start_date, max(trade_date) AS end_date,
      count(*) AS trading_days, product(1 + strategy_daily_return) - 1 AS strategy_return, product(1 + benchmark_daily_return) - 1 AS benchmark_return FROM b_returns GROUP BY ALL) LEFT JOIN (SELECT strftime(trade_date, '%Y-%m') AS month, count(*) AS failed_orders FROM b_orders WHERE order_status = 'FAILED' GROUP BY 1) USING (month)""",
}


def _ledger(p: Panels):
    return p.ledger


def _codes(p: Panels):
    return p.step("codes", lambda: p["b_daily"].select("ts_code", "suppkey").distinct())


def _wanted(p: Panels):
    """Targets on their scheduled days, by supplier."""
    days = p.schedule.where("scheduled_trade_date is not null").select("signal_date", F.col("scheduled_trade_date").alias("trade_date"))
    return p.step("wanted", lambda: p.targets.join(days, "signal_date").join(_codes(p).withColumnRenamed("ts_code", "canonical_ts_code"), "canonical_ts_code"))


def _days(p: Panels):
    """The scheduled days that have targets."""
    return p.step("rebalance_days", lambda: p.targets.join(p.schedule.where("scheduled_trade_date is not null"), "signal_date").select(F.col("scheduled_trade_date").alias("trade_date")).distinct())


def _valued(p: Panels):
    def build():
        held = po.positions_at(_ledger(p), ["portfolio_id", "suppkey"], _days(p))
        return po.open_valuation(held, p["b_daily"], "suppkey", p.cash.where("is_baseline"), _days(p), ["ts_code", "suppkey"], p._keep)

    return p.once("valued", build)


def _orders(p: Panels):
    return p.once("new_orders", lambda: po.rebalance_orders(_valued(p), _wanted(p), "suppkey", p._keep))


def _gated(p: Panels):
    return p.once("gated", lambda: po.execution_gate(_orders(p), p.status_on(_days(p)).join(_codes(p), "ts_code"), "suppkey"))


def _stale(p: Panels):
    return p.stale


def _refs(p: Panels):
    return po.corporate_action_refs(p["b_code_history"], p.daily, RATIO)


plan("composite_topn", lambda p: p.targets, "SELECT * FROM t_targets", "composite_score target_weight", 7)
plan("rebalance_schedule", lambda p: p.schedule, "SELECT * FROM t_schedule")
_mi = "canonical_ts_code, trade_date, raw_open, adjusted_open, adjusted_close"
plan(
    "market_inputs",
    lambda p: po.market_inputs(p.daily, p.targets, p.schedule),
    "SELECT canonical_ts_code, trade_date, open AS raw_open, open_hfq AS adjusted_open, close_hfq AS adjusted_close FROM t_daily WHERE is_within_listing_window AND security_code_interval_valid AND canonical_ts_code IN (SELECT canonical_ts_code FROM t_targets) AND trade_date IN (SELECT scheduled_trade_date FROM t_schedule)",
    "raw_open adjusted_open adjusted_close",
    6,
)
_selected = "(SELECT canonical_ts_code FROM t_targets UNION SELECT old_ts_code FROM b_code_history UNION SELECT new_ts_code FROM b_code_history)"
_END = "2001-12-31"


def _market(p: Panels):
    codes = p.step("selected_codes", lambda: po.selected_codes(p.targets, p["b_code_history"]))
    return po.market_prices(p.daily, codes, p.schedule, _END), po.market_executions(p.status, codes, p.schedule)


_price_sql = f"""SELECT ts_code, canonical_ts_code, trade_date, open AS raw_open, close AS raw_close, adj_factor, open_hfq AS adjusted_open, close_hfq AS adjusted_close FROM t_daily WHERE is_sh_sz AND is_within_listing_window AND security_code_interval_valid
      AND canonical_ts_code IN {_selected} AND trade_date BETWEEN (SELECT min(signal_date) FROM t_schedule) AND DATE '{_END}'"""
_state = "ts_code, canonical_ts_code, trade_date, open_price, has_daily_price, has_suspend_record, suspended_at_open, up_limit, down_limit, open_at_up_limit, open_at_down_limit, cannot_buy_at_open, cannot_sell_at_open, execution_block_reason"
_state_sql = f"SELECT {_state} FROM t_exec WHERE security_code_interval_valid AND canonical_ts_code IN {_selected} AND trade_date IN (SELECT scheduled_trade_date FROM t_schedule)"
plan("market_prices", lambda p: _market(p)[0], _price_sql, "raw_open raw_close adj_factor adjusted_open adjusted_close", 5)
plan("market_executions", lambda p: _market(p)[1], _state_sql, "open_price up_limit down_limit", 5)


def _market_checks(p: Panels):
    key = ["canonical_ts_code", "trade_date"]
    prices, states = _market(p)
    return qa.duplicate_keys({"market_prices": (prices, key), "market_executions": (states, key)})


plan(
    "market_input_checks",
    _market_checks,
    " UNION ALL ".join(f"SELECT '{n}' AS check_id, 'KEY_UNIQUENESS' AS category, count(*) AS observed, 0::BIGINT AS expected, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS n FROM ({q}) GROUP BY canonical_ts_code, trade_date) WHERE n > 1" for n, q in (("market_prices", _price_sql), ("market_executions", _state_sql))),
)
plan(
    "fee_gaps",
    lambda p: po.fee_gaps(p["b_orders"].select("trade_date").union(p["events"].select(F.col("ts").cast("date"))), p["b_fees"]),
    "SELECT trade_date, count(f.sell_rate) AS regimes FROM (SELECT trade_date FROM b_orders UNION SELECT CAST(ts AS DATE) FROM events) d LEFT JOIN b_fees f ON d.trade_date BETWEEN f.effective_from AND f.effective_to WHERE trade_date IS NOT NULL GROUP BY trade_date HAVING count(f.sell_rate) <> 1",
)
_ord = ["orderkey", "linenumber", "partkey", "suppkey", "trade_date"]
plan("scenario_expand", lambda p: po.scenario_expand(p["b_orders"].select(*_ord, "executed_notional"), p["b_scenarios"]), f"SELECT {', '.join(_ord)}, executed_notional, cost_scenario, commission_rate, is_baseline FROM b_orders CROSS JOIN b_scenarios", "executed_notional commission_rate", 4)
plan("fee_schedule", lambda p: po.fee_schedule(p["b_orders"].select("trade_date").distinct(), p["b_fees"]), "SELECT trade_date, sell_rate FROM (SELECT DISTINCT trade_date FROM b_orders) LEFT JOIN b_fees ON trade_date BETWEEN effective_from AND effective_to", "sell_rate")
_cost = [*_ord, "cost_scenario", "side", "sell_rate", "commission_cost", "stamp_duty_cost", "total_trading_cost"]
plan("trade_costs", lambda p: po.trade_costs(p["b_orders"], p["b_scenarios"], p["b_fees"]).select(*_cost), f"SELECT {', '.join(_cost[:-1])}, commission_cost + stamp_duty_cost AS total_trading_cost FROM t_costs", "sell_rate commission_cost stamp_duty_cost total_trading_cost", 4)
plan("position_ledger", _ledger, "SELECT * FROM t_ledger", "units_traded units_after", 4)
plan("open_valuation", lambda p: _valued(p).select("portfolio_id", "suppkey", "trade_date", "units", "price", "current_value", "pretrade_nav"), "SELECT portfolio_id, suppkey, trade_date, units, price, current_value, pretrade_nav FROM t_valued", "units price current_value pretrade_nav", 4)
plan("rebalance_orders", _orders, "SELECT * FROM t_orders", "current_value target_value desired_notional", 4)
_gate = ["portfolio_id", "suppkey", "trade_date", "side", "failure_reason", "order_status"]
plan("execution_gate", lambda p: _gated(p).select(*_gate), f"SELECT {', '.join(_gate)} FROM t_gated")
plan(
    "cash_scaling",
    lambda p: po.cash_scaling(_gated(p), p["b_scenarios"], p["b_fees"], p.cash),
    """SELECT *, CASE WHEN cash_scaling_factor <= 0 THEN 'INSUFFICIENT_CASH' WHEN cash_scaling_factor < 1 - 1e-12 THEN 'PARTIAL_CASH_CONSTRAINT' ELSE 'FILLED' END AS buy_status FROM (
      SELECT *, CASE WHEN total_buy_demand > 0 THEN least(1.0::DOUBLE, greatest(available_cash, 0) / (total_buy_demand * (1 + commission_rate))) ELSE 1.0::DOUBLE END AS cash_scaling_factor FROM t_cash)""",
    "total_buy_demand sell_proceeds available_cash commission_rate cash_scaling_factor",
    4,
)
plan("stale_valuation", _stale, "SELECT * FROM t_stale", "units price market_value", 4)
plan("stale_valuation_all_days", _stale, None, "units price market_value", 4)


def _stale_summary(p: Panels):
    return po.stale_summary(_stale(p), ["portfolio_id", "suppkey"], p.accounts.where("is_baseline"), p._keep)


plan("stale_summary_all_days", _stale_summary, None, "terminal_value terminal_weight", 6)
plan(
    "stale_summary",
    _stale_summary,
    "SELECT portfolio_id, suppkey, min(trade_date) AS first_stale_date, max(trade_date) AS last_stale_date, count(*) AS stale_days, max(stale_calendar_days) AS maximum_stale_days, min(trade_date) FILTER (WHERE stale_calendar_days = m) AS date_of_maximum, max_by(trade_date - stale_calendar_days, trade_date) AS last_price_date, bool_or(trade_date = d) AS stale_at_end, max(CASE WHEN trade_date = d THEN market_value END) AS terminal_value, max(CASE WHEN trade_date = d AND total_nav > 0 THEN market_value / total_nav END) AS terminal_weight FROM (SELECT s.*, a.total_nav, max(stale_calendar_days) OVER (PARTITION BY s.portfolio_id, suppkey) AS m FROM (SELECT *, max(trade_date) OVER () AS d FROM t_stale) s LEFT JOIN (SELECT * FROM t_acc WHERE is_baseline) a ON a.portfolio_id = s.portfolio_id AND a.trade_date = s.trade_date WHERE stale_calendar_days > 0) GROUP BY ALL",
    "terminal_value terminal_weight",
    6,
)
plan("corporate_action_refs", _refs, "SELECT * FROM t_refs", "old_close old_factor successor_open successor_factor conversion_ratio")
_held_old = "SELECT h.portfolio_id, r.*, max_by(h.units_after, h.trade_date) AS units FROM t_ledger h JOIN (SELECT DISTINCT ts_code, suppkey FROM b_daily) c USING (suppkey) JOIN t_refs r ON r.old_ts_code = c.ts_code WHERE h.trade_date < r.effective_date GROUP BY ALL"


def _convert(p: Panels):
    codes = p["b_daily"].select("suppkey", F.col("ts_code").alias("old_ts_code")).distinct()
    held = _ledger(p).join(codes, "suppkey").join(_refs(p).select("old_ts_code", "effective_date"), "old_ts_code").where("trade_date < effective_date")
    return po.corporate_action_convert(held.groupBy("portfolio_id", "old_ts_code").agg(F.max_by("units_after", "trade_date").alias("units")).where(F.abs("units") > 1e-12), _refs(p))


plan(
    "corporate_action_convert",
    _convert,
    f"SELECT portfolio_id, old_ts_code, new_ts_code, effective_date, units AS old_units, n AS new_units, units * old_close * old_factor / n AS carry_price, n * (units * old_close * old_factor / n) - units * old_close * old_factor AS value_difference, 'CORPORATE_ACTION' AS activity_type FROM (SELECT *, units * old_factor * conversion_ratio / successor_factor AS n FROM ({_held_old}) WHERE abs(units) > 1e-12)",
    "old_units new_units carry_price value_difference",
    5,
)
_code_sql = "(SELECT DISTINCT ts_code, suppkey FROM b_daily)"
_signed = "CASE WHEN side = 'BUY' THEN executed_units ELSE -executed_units END"
PANELS |= {
    "t_trades": f"SELECT portfolio_id, ts_code, trade_date, sum({_signed}) AS units_traded FROM b_orders JOIN {_code_sql} USING (suppkey) GROUP BY ALL",
    "t_action": """SELECT t.portfolio_id, r.old_ts_code, r.new_ts_code, r.effective_date, r.old_close, r.old_factor, r.successor_factor, r.conversion_ratio, sum(units_traded) FILTER (WHERE t.ts_code = r.old_ts_code) AS units,
        sum(units_traded) FILTER (WHERE t.ts_code = r.new_ts_code) AS successor_units FROM t_refs r JOIN t_trades t ON t.ts_code IN (r.old_ts_code, r.new_ts_code) AND t.trade_date < r.effective_date GROUP BY ALL HAVING abs(sum(units_traded) FILTER (WHERE t.ts_code = r.old_ts_code)) > 1e-12""",
    "t_action_rows": """SELECT portfolio_id, unnest([old_ts_code, new_ts_code]) AS ts_code, effective_date AS trade_date, unnest([-units, units * old_factor * conversion_ratio / successor_factor]) AS units_traded, unnest(['ACTION_OUT', 'ACTION_IN']) AS activity,
        unnest([NULL, old_close * successor_factor / conversion_ratio]) AS carry_price, coalesce(abs(successor_units) > 1e-12, false) AS successor_was_held FROM t_action""",
    "t_carry_ledger": """SELECT portfolio_id, ts_code, trade_date, sum(u) OVER (PARTITION BY portfolio_id, ts_code ORDER BY trade_date) AS units, lead(trade_date) OVER (PARTITION BY portfolio_id, ts_code ORDER BY trade_date) AS following
        FROM (SELECT portfolio_id, ts_code, trade_date, sum(units_traded) AS u FROM (SELECT portfolio_id, ts_code, trade_date, units_traded FROM t_trades UNION ALL SELECT portfolio_id, ts_code, trade_date, units_traded FROM t_action_rows) GROUP BY ALL)""",
    "t_carry_price": """SELECT ts_code, trade_date, close_hfq AS price, trade_date AS pd, 'CLOSE' AS kind FROM t_daily WHERE security_code_interval_valid AND close_hfq > 0
        UNION ALL SELECT new_ts_code, effective_date, old_close * successor_factor / conversion_ratio, old_last_date, 'CORPORATE_ACTION_CARRY_VALUE' FROM t_refs r WHERE NOT EXISTS (SELECT 1 FROM t_daily d WHERE d.ts_code = r.new_ts_code AND d.trade_date = r.effective_date AND d.security_code_interval_valid AND d.close_hfq > 0)""",
    "t_carried": """SELECT m.portfolio_id, m.ts_code, m.trade_date, units, price, CASE WHEN kind = 'CLOSE' AND pd < m.trade_date THEN 'STALE_CLOSE' ELSE kind END AS price_source, (m.trade_date - pd)::INT AS stale_calendar_days, units * price AS market_value
        FROM (SELECT l.portfolio_id, l.ts_code, l.units, b.trade_date FROM t_carry_ledger l JOIN b_benchmark b ON b.trade_date >= l.trade_date AND (l.following IS NULL OR b.trade_date < l.following) WHERE l.units > 1e-12) m ASOF LEFT JOIN t_carry_price q ON q.ts_code = m.ts_code AND q.trade_date <= m.trade_date""",
}


def _trades(p: Panels):
    return p.step("trades", lambda: p["b_orders"].join(_codes(p), "suppkey").groupBy("portfolio_id", "ts_code", "trade_date").agg(F.sum(po.signed_units()).alias("units_traded")))


def action_rows_of(trades, refs):
    """Positions in old codes and their successors before the effective day, as ledger rows."""
    names = refs.select("old_ts_code", "new_ts_code", "effective_date")
    sides = F.array(F.struct(F.col("old_ts_code").alias("ts_code"), F.lit("units").alias("which")), F.struct(F.col("new_ts_code").alias("ts_code"), F.lit("successor_units").alias("which")))
    side = names.select("old_ts_code", "effective_date", F.explode(sides).alias("s")).select("old_ts_code", "effective_date", "s.*")
    both = trades.join(side, "ts_code").where("trade_date < effective_date").groupBy("portfolio_id", "old_ts_code").pivot("which", ["units", "successor_units"]).agg(F.sum("units_traded"))
    return po.action_rows(both.where(F.abs("units") > po.EPSILON), refs)


def _action_rows(p: Panels):
    return p.step("action_rows", lambda: action_rows_of(_trades(p), _refs(p)))


def _carried(p: Panels):
    rows = _action_rows(p).select("portfolio_id", "ts_code", "trade_date", "units_traded")
    return po.carried_valuation(_trades(p).unionByName(rows), p.daily, _refs(p), p["b_benchmark"])


plan("corporate_action_rows", _action_rows, "SELECT * FROM t_action_rows", "units_traded carry_price", 5)
plan("carried_valuation", _carried, "SELECT * FROM t_carried", "units price market_value", 4)
_sequence = ["trade_date", "orderkey", "linenumber", "partkey"]
_line = f"(PARTITION BY portfolio_id, suppkey ORDER BY {', '.join(_sequence)})"
plan(
    "failed_sell_runs",
    lambda p: po.failed_sell_runs(p["b_orders"], ["portfolio_id", "suppkey"], _sequence),
    f"""SELECT portfolio_id, suppkey, first_failed_date, last_failed_date, failed_orders, desired_notional, units_before, units_after, ended_by, units_before = units_after AND e = 0 AS units_preserved FROM (
      SELECT portfolio_id, suppkey, min(trade_date) AS first_failed_date, max(trade_date) AS last_failed_date, count(*) AS failed_orders, sum(desired_notional) AS desired_notional, arg_min(u - m, n) AS units_before, arg_max(u, n) AS units_after, sum(executed_notional) AS e, coalesce(arg_max(nx, n), 'NONE') AS ended_by
      FROM (SELECT *, n - row_number() OVER (PARTITION BY portfolio_id, suppkey, f ORDER BY n) AS island FROM (SELECT *, side = 'SELL' AND order_status = 'FAILED' AS f, {_signed} AS m, sum({_signed}) OVER {_line} AS u, row_number() OVER {_line} AS n, lead(side || '_' || order_status) OVER {_line} AS nx FROM b_orders)) WHERE f GROUP BY portfolio_id, suppkey, island)""",
    "desired_notional units_before units_after",
    4,
)
plan(
    "reserved_cash",
    lambda p: po.reserved_cash(p["b_orders"], p.accounts, p["b_scenarios"]),
    """SELECT portfolio_id, cost_scenario, trade_date, blocked_notional, blocked_buys, reserved AS reserved_cash, cash, coalesce(cash + 0.01 < reserved, true) AS is_violated FROM (
      SELECT b.portfolio_id, s.cost_scenario, b.trade_date, blocked_notional, blocked_buys, blocked_notional * (1 + s.commission_rate) AS reserved, a.cash FROM (SELECT portfolio_id, trade_date, sum(desired_notional) AS blocked_notional, count(*) AS blocked_buys FROM b_orders WHERE side = 'BUY' AND order_status = 'FAILED' GROUP BY ALL) b
      CROSS JOIN b_scenarios s LEFT JOIN t_acc a ON a.portfolio_id = b.portfolio_id AND a.trade_date = b.trade_date AND a.cost_scenario = s.cost_scenario)""",
    "blocked_notional reserved_cash cash",
    2,
)
plan("nav_daily", lambda p: p.nav, "SELECT * FROM t_nav", "strategy_daily_return benchmark_daily_return strategy_nav benchmark_nav strategy_drawdown benchmark_drawdown relative_nav")
# NAVs of the test data span many powers of ten, so the query gives their logarithms.
_drift = "signal_date, trade_date, turnover, growth"
plan(
    "drift_nav",
    lambda p: po.drift_nav(p.targets, p.schedule, p.daily, BASE_COST).withColumn("log_nav_at_end", F.ln("nav_at_end")).drop("nav_at_end"),
    f"SELECT {_drift}, ln(nav_at_end) AS log_nav_at_end FROM ({_drifting('t_targets', str(BASE_COST))})",
    "turnover growth log_nav_at_end",
    7,
)
_money = ["executed_buy_notional", "executed_sell_notional", "commission_cost", "stamp_duty_cost", "total_trading_cost", "cash", "market_value", "stale_market_value", "total_nav"]
_counts = ["holding_count", "stale_position_count", "maximum_stale_calendar_days", "failed_buy_orders", "failed_sell_orders", "partial_order_count"]
_ratios = ["strategy_nav", "benchmark_nav", "strategy_daily_return", "benchmark_daily_return", "strategy_drawdown", "benchmark_drawdown", "relative_nav", "turnover_ratio", "cash_weight", "market_value_weight", "stale_weight"]
_account = ["portfolio_id", "cost_scenario", "is_baseline", "trade_date", *_counts]
plan(
    "account_daily",
    lambda p: p.accounts.select(*_account, *_ratios, *((F.col(c) / 1e6).alias(f"{c}_millions") for c in _money)),
    f"SELECT {', '.join([*_account, *_ratios])}, {', '.join(f'{c} / 1e6::DOUBLE AS {c}_millions' for c in _money)} FROM t_acc",
    " ".join([*_ratios, *(f"{c}_millions" for c in _money)]),
    6,
)
plan(
    "rebalance_summary",
    lambda p: po.rebalance_summary(p["b_orders"]),
    """SELECT portfolio_id, trade_date, count(*) AS orders, count(*) FILTER (WHERE side = 'BUY') AS buy_orders, count(*) FILTER (WHERE side <> 'BUY') AS sell_orders, count(*) FILTER (WHERE order_status = 'FAILED' AND side = 'BUY') AS failed_buys, count(*) FILTER (WHERE order_status = 'FAILED' AND side <> 'BUY') AS failed_sells,
      count(*) FILTER (WHERE order_status = 'PARTIAL_CASH_CONSTRAINT') AS partial_buys, sum(desired_notional) AS desired_notional, sum(CASE WHEN side = 'BUY' THEN executed_notional ELSE 0 END) AS executed_buy_notional, sum(CASE WHEN side <> 'BUY' THEN executed_notional ELSE 0 END) AS executed_sell_notional FROM b_orders GROUP BY ALL""",
    "desired_notional executed_buy_notional executed_sell_notional",
    4,
)
plan("failure_summary", lambda p: po.failure_summary(p["b_orders"]), "SELECT portfolio_id, side, failure_reason, count(*) AS orders, sum(desired_notional) AS desired_notional, sum(executed_notional) AS executed_notional FROM b_orders WHERE order_status = 'FAILED' GROUP BY ALL", "desired_notional executed_notional", 2)

# Performance
plan("performance_summary", lambda p: pf.performance_summary(p.nav), "SELECT * FROM t_perf", _METRICS + " annualized_return_difference", 7)
_extra = ["average_cash_weight", "maximum_cash_weight", "maximum_stale_weight", "terminal_stale_weight", "terminal_stale_share_of_capital", "cumulative_two_way_turnover", "total_commission_cost_share", "total_stamp_duty_cost_share", "total_trading_cost_share", "annualized_two_way_turnover"]
plan(
    "account_performance",
    lambda p: pf.account_performance(p.accounts),
    """SELECT *, cumulative_two_way_turnover / greatest((trading_days - 1) / 252, 1 / 252) AS annualized_two_way_turnover FROM t_perf_acc JOIN (
      SELECT portfolio_id, cost_scenario, avg(cash_weight) AS average_cash_weight, max(cash_weight) FILTER (WHERE trade_date >= begun) AS maximum_cash_weight, max(stale_weight) AS maximum_stale_weight, max_by(stale_weight, trade_date) AS terminal_stale_weight, max_by(stale_market_value, trade_date) / max(initial_capital) AS terminal_stale_share_of_capital,
        max(maximum_stale_calendar_days) AS maximum_stale_calendar_days, sum(turnover_ratio) AS cumulative_two_way_turnover, sum(commission_cost) / max(initial_capital) AS total_commission_cost_share, sum(stamp_duty_cost) / max(initial_capital) AS total_stamp_duty_cost_share, sum(total_trading_cost) / max(initial_capital) AS total_trading_cost_share,
        sum(failed_buy_orders)::BIGINT AS failed_buy_orders, sum(failed_sell_orders)::BIGINT AS failed_sell_orders, sum(partial_order_count)::BIGINT AS partial_order_count FROM (SELECT *, min(CASE WHEN executed_buy_notional + executed_sell_notional > 0 THEN trade_date END) OVER (PARTITION BY portfolio_id, cost_scenario) AS begun FROM t_acc) GROUP BY ALL) USING (portfolio_id, cost_scenario)""",
    f"{_METRICS} annualized_return_difference {' '.join(_extra)}",
    6,
)
_weights = ["average_cash_weight", "maximum_cash_weight", "minimum_cash_weight", "average_stale_weight", "maximum_stale_weight", "terminal_stale_weight", "two_way_turnover", "trading_cost_share"]
plan(
    "account_periods",
    lambda p: pf.account_periods(p.accounts, PERIODS),
    f"""SELECT * FROM t_period_acc JOIN (SELECT portfolio_id, cost_scenario, period, avg(cash_weight) AS average_cash_weight, max(cash_weight) AS maximum_cash_weight, min(cash_weight) AS minimum_cash_weight, avg(stale_weight) AS average_stale_weight, max(stale_weight) AS maximum_stale_weight,
      max_by(stale_weight, trade_date) AS terminal_stale_weight, max(maximum_stale_calendar_days) AS maximum_stale_calendar_days, count(*) FILTER (WHERE stale_position_count > 0) AS stale_days, sum(turnover_ratio) AS two_way_turnover, sum(total_trading_cost) / max(initial_capital) AS trading_cost_share,
      sum(failed_buy_orders)::BIGINT AS failed_buy_orders, sum(failed_sell_orders)::BIGINT AS failed_sell_orders, sum(partial_order_count)::BIGINT AS partial_order_count FROM t_acc JOIN {PERIOD_SQL} ON trade_date BETWEEN p.a AND p.b GROUP BY ALL) USING (portfolio_id, cost_scenario, period)""",
    f"{_METRICS} {' '.join(_weights)}",
    6,
)
plan(
    "account_monthly",
    lambda p: pf.account_monthly(p.accounts),
    """SELECT *, strategy_return - benchmark_return AS excess_return FROM (SELECT portfolio_id, cost_scenario, strftime(trade_date, '%Y-%m') AS month, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS trading_days, product(1 + strategy_daily_return) - 1 AS strategy_return, product(1 + benchmark_daily_return) - 1 AS benchmark_return,
      sum(turnover_ratio) AS turnover, sum(total_trading_cost) / max(initial_capital) AS trading_cost_share, max(stale_weight) AS maximum_stale_weight, avg(cash_weight) AS average_cash_weight, sum(failed_buy_orders + failed_sell_orders)::BIGINT AS failed_orders FROM t_acc GROUP BY ALL)""",
    "strategy_return benchmark_return turnover trading_cost_share maximum_stale_weight average_cash_weight excess_return",
    6,
)
plan("period_performance", lambda p: pf.period_performance(p["b_returns"], PERIODS), "SELECT * FROM t_period", _METRICS, 7)
plan("annual_performance", lambda p: pf.annual_performance(p["b_returns"]), "SELECT * FROM t_annual", _METRICS, 7)
_cm = ["strategy_annualized_return", "strategy_annualized_volatility", "strategy_sharpe_zero_rf", "strategy_max_drawdown"]
plan(
    "scenario_compare",
    lambda p: pf.scenario_compare(pf.period_performance(p["b_returns"], PERIODS), "RESEARCH", "VALIDATION"),
    "SELECT cost_scenario, " + ", ".join(f"max({m}) FILTER (WHERE period = 'RESEARCH') AS {m}_before, max({m}) FILTER (WHERE period = 'VALIDATION') AS {m}_after, max({m}) FILTER (WHERE period = 'VALIDATION') - max({m}) FILTER (WHERE period = 'RESEARCH') AS {m}_difference" for m in _cm) + " FROM t_period GROUP BY cost_scenario",
    " ".join(f"{m}_{x}" for m in _cm for x in ("before", "after", "difference")),
    7,
)
_bm = ["strategy_total_return", "strategy_max_drawdown", "information_ratio"]
plan(
    "before_after_impact",
    lambda p: pf.before_after_impact(*(pf.period_performance(p["b_returns"], PERIODS).where(F.col("period") == x) for x in ("RESEARCH", "OOS")), _bm),
    " UNION ALL ".join(f"SELECT o.cost_scenario, '{m}' AS metric, o.{m} AS before, n.{m} AS after, n.{m} - o.{m} AS difference FROM t_period o JOIN t_period n ON n.cost_scenario = o.cost_scenario AND n.period = 'OOS' WHERE o.period = 'RESEARCH'" for m in _bm),
    "before after difference",
    7,
)
plan("monthly_diagnostics", lambda p: pf.monthly_diagnostics(p["b_returns"], p["b_orders"]), "SELECT * FROM t_monthly", "strategy_return benchmark_return excess_return")
plan(
    "worst_months",
    lambda p: pf.worst_months(pf.monthly_diagnostics(p["b_returns"], p["b_orders"])),
    "SELECT cost_scenario, month, ranking_type, value, worst_rank FROM (SELECT *, row_number() OVER (PARTITION BY cost_scenario, ranking_type ORDER BY round(value, 10), month)::INT AS worst_rank FROM (SELECT cost_scenario, month, 'WORST_STRATEGY_RETURN' AS ranking_type, strategy_return AS value FROM t_monthly UNION ALL SELECT cost_scenario, month, 'WORST_EXCESS_RETURN', excess_return FROM t_monthly)) WHERE worst_rank <= 10",
    "value",
)
plan(
    "drawdown_episode",
    lambda p: pf.drawdown_episode(p["b_returns"]),
    """WITH r AS (SELECT *, product(1 + strategy_daily_return) OVER (PARTITION BY cost_scenario ORDER BY trade_date) AS nav FROM b_returns), f AS (SELECT *, max(nav) OVER (PARTITION BY cost_scenario ORDER BY trade_date) AS peak FROM r),
    t AS (SELECT * FROM (SELECT cost_scenario, trade_date AS trough_date, peak, round(nav / peak - 1, 12) AS fall, row_number() OVER (PARTITION BY cost_scenario ORDER BY round(nav / peak - 1, 12), trade_date) AS rn FROM f) WHERE rn = 1),
    e AS (SELECT t.cost_scenario, min(f.trade_date) FILTER (WHERE f.trade_date <= trough_date AND round(f.nav, 12) >= round(t.peak, 12)) AS peak_date, trough_date, min(f.trade_date) FILTER (WHERE f.trade_date >= trough_date AND round(f.nav, 12) >= round(t.peak, 12)) AS recovery_date, fall FROM t JOIN f USING (cost_scenario) GROUP BY ALL)
    SELECT cost_scenario, peak_date, trough_date, recovery_date, fall AS maximum_drawdown, (trough_date - peak_date)::INT AS calendar_days_peak_to_trough, (recovery_date - peak_date)::INT AS calendar_days_to_recovery, recovery_date IS NOT NULL AS recovered_by_end FROM e""",
    "maximum_drawdown",
)
plan(
    "chart_series",
    lambda p: pf.chart_series(p.nav, pf.annual_performance(p["b_returns"])),
    " UNION ALL ".join([f"SELECT cost_scenario, '{v}' AS series, CAST(trade_date AS VARCHAR) AS position, {v} AS value FROM t_nav" for v in ("strategy_nav", "benchmark_nav", "strategy_drawdown", "relative_nav")] + [f"SELECT cost_scenario, '{v}', CAST(year AS VARCHAR), {v} FROM t_annual" for v in ("strategy_total_return", "benchmark_total_return")]),
    "value",
    7,
)

# Robustness
_Z = [f"{f}_z" for f in FACTORS]
PANELS |= {
    "t_micro": "SELECT * FROM (SELECT *, quantile_cont(total_mv_cny, 0.2) OVER (PARTITION BY signal_date) AS microcap_cutoff FROM t_panel WHERE universe_eligible) WHERE round(total_mv_cny, 4) >= round(microcap_cutoff, 4)",
    "t_ind": "SELECT * EXCLUDE (" + ", ".join(f"d_{z}" for z in _Z) + ") REPLACE (" + ", ".join(f"CASE WHEN stddev_samp(d_{z}) OVER m > 0 THEN (d_{z} - avg(d_{z}) OVER m) / stddev_samp(d_{z}) OVER m END AS {z}" for z in _Z) + ") FROM (SELECT *, " + ", ".join(f"{z} - avg({z}) OVER (PARTITION BY signal_date, coalesce(industry_code, 'UNKNOWN')) AS d_{z}" for z in _Z) + " FROM t_panel WHERE universe_eligible) WINDOW m AS (PARTITION BY signal_date)",
    "t_size": "SELECT * EXCLUDE (" + ", ".join(f"d_{z}" for z in _Z) + ") REPLACE (" + ", ".join(f"CASE WHEN stddev_samp(d_{z}) OVER m > 0 THEN (d_{z} - avg(d_{z}) OVER m) / stddev_samp(d_{z}) OVER m END AS {z}" for z in _Z) + ") FROM (SELECT p.*, " + ", ".join(f"CASE WHEN l.n_{z} >= 3 AND l.s_{z} > 0 THEN p.{z} - (l.a_{z} + l.b_{z} * ln(p.total_mv_cny)) END AS d_{z}" for z in _Z) + " FROM t_panel p JOIN (SELECT signal_date, " + ", ".join(f"count({z}) AS n_{z}, stddev_samp(CASE WHEN {z} IS NOT NULL THEN ln(total_mv_cny) END) AS s_{z}, regr_slope({z}, ln(total_mv_cny)) AS b_{z}, regr_intercept({z}, ln(total_mv_cny)) AS a_{z}" for z in _Z) + " FROM t_panel WHERE universe_eligible GROUP BY signal_date) l USING (signal_date) WHERE universe_eligible) WINDOW m AS (PARTITION BY signal_date)",
}
_keep = [*fc.KEY, *_Z]
plan("microcap_filter", lambda p: rb.microcap_filter(p.factor_panel).select(*fc.KEY, "total_mv_cny", "microcap_cutoff"), f"SELECT {KEY}, total_mv_cny, microcap_cutoff FROM t_micro", "total_mv_cny microcap_cutoff", 3)
plan("industry_neutral", lambda p: rb.industry_neutral(p.factor_panel).select(*_keep), f"SELECT {KEY}, {', '.join(_Z)} FROM t_ind", " ".join(_Z), 6)
plan("size_neutral", lambda p: rb.size_neutral(p.factor_panel).select(*_keep), f"SELECT {KEY}, {', '.join(_Z)} FROM t_size", " ".join(_Z), 6)


def _variants(p: Panels):
    return {
        "BASELINE": p.factor_panel,
        "MICROCAP_EXCLUDE_BOTTOM20": rb.microcap_filter(p.factor_panel),
        "MOMENTUM_9_1": p.factors(FactorRules(lookback=189)),
        "LOWVOL_120": p.factors(FactorRules(volatility_window=120)),
        "INDUSTRY_NEUTRAL": rb.industry_neutral(p.factor_panel),
        "LOG_SIZE_NEUTRAL": rb.size_neutral(p.factor_panel),
    }


_known = "universe_eligible AND " + " AND ".join(f"{z} IS NOT NULL" for z in _Z)
PANELS["t_variants"] = " UNION ALL ".join(f"SELECT *, '{n}' AS experiment_id FROM ({_topn(t, _known)})" for n, t in (("BASELINE", "t_panel"), ("MICROCAP_EXCLUDE_BOTTOM20", "t_micro"), ("MOMENTUM_9_1", "t_panel_m"), ("LOWVOL_120", "t_panel_v"), ("INDUSTRY_NEUTRAL", "t_ind"), ("LOG_SIZE_NEUTRAL", "t_size")))
_vw = ["momentum_12_1", "lowvol_60"]
plan(
    "variant_windows",
    lambda p: p.factors(FactorRules(lookback=189)).select(*fc.KEY, F.lit("MOMENTUM_9_1").alias("experiment_id"), "universe_eligible", *_vw).union(p.factors(FactorRules(volatility_window=120)).select(*fc.KEY, F.lit("LOWVOL_120"), "universe_eligible", *_vw)),
    f"SELECT {KEY}, 'MOMENTUM_9_1' AS experiment_id, universe_eligible, momentum_12_1, lowvol_60 FROM t_panel_m UNION ALL SELECT {KEY}, 'LOWVOL_120', universe_eligible, momentum_12_1, lowvol_60 FROM t_panel_v",
    " ".join(_vw),
)
plan("variant_signals", lambda p: p.variant_signals(_variants, 20), "SELECT * FROM t_variants", "composite_score target_weight", 6)


def _registry(p: Panels):
    selected = rb.at_other_costs(p.variant_signals(_variants, 20), "BASELINE", list(COSTS))
    cost = F.lit(BASE_COST)
    for name, rate in COSTS.items():
        cost = F.when(F.col("experiment_id") == name, rate).otherwise(cost)
    nav = p.step("experiment_nav", lambda: po.drift_nav(selected, p.schedule, p.daily, cost, ["experiment_id"]))
    return p.step("registry", lambda: rb.experiment_registry(selected, nav, cost))


def _recovery(p: Panels):
    stale = p["orders"].groupBy(F.col("o_orderstatus").alias("cost_scenario")).agg((F.max("o_totalprice") / 10).alias("carrying_value"), (F.min("o_totalprice") / 1e6).alias("stale_weight"))
    return rb.recovery_sensitivity(pf.performance_summary(p.nav), stale, [0.0, 0.25, 0.5, 0.75, 1.0])


_cost_sql = f"(CASE experiment_id {' '.join(f"WHEN '{n}' THEN {r}::DOUBLE" for n, r in COSTS.items())} ELSE {BASE_COST}::DOUBLE END)"
PANELS["t_exp"] = "SELECT * FROM t_variants" + "".join(f" UNION ALL SELECT * REPLACE ('{n}' AS experiment_id) FROM t_variants WHERE experiment_id = 'BASELINE'" for n in COSTS)
PANELS["t_registry"] = f"""SELECT *, CASE WHEN end_date > start_date THEN log_total_return / ((end_date - start_date) / 365.25) END AS annualized_log_return FROM (
      SELECT experiment_id, sum(n)::BIGINT AS selected_rows, count(*) AS signal_months, min(n) AS minimum_selected, max(n) AS maximum_selected, avg(n) AS average_selected FROM (SELECT experiment_id, signal_date, count(*) AS n FROM t_exp GROUP BY ALL) GROUP BY experiment_id) LEFT JOIN (
      SELECT experiment_id, min(trade_date) AS start_date, max(trade_date) AS end_date, ln(max_by(nav_at_end, trade_date)) AS log_total_return, least(min(fall), 0) AS maximum_drawdown, sum(turnover) AS two_way_turnover, sum({_cost_sql} * turnover) AS trading_cost_share
      FROM (SELECT *, nav_at_end / greatest(1, max(nav_at_end) OVER (PARTITION BY experiment_id ORDER BY trade_date)) - 1 AS fall FROM ({_drifting('t_exp', _cost_sql, 'experiment_id,')})) GROUP BY experiment_id) USING (experiment_id)"""
plan(
    "experiment_registry",
    _registry,
    "SELECT * FROM t_registry",
    "average_selected log_total_return maximum_drawdown two_way_turnover trading_cost_share annualized_log_return",
    6,
)
PANELS["t_recovery"] = """SELECT cost_scenario, recovery_rate, tn AS original_terminal_nav, tr AS adjusted_total_return, pow(1 + tr, 252 / trading_days) - 1 AS adjusted_annualized_return, tr - strategy_total_return AS total_return_change, pow(1 + tr, 252 / trading_days) - 1 - strategy_annualized_return AS annualized_return_change FROM (
      SELECT *, (tn - cv * (1 - recovery_rate)) / (tn / (1 + strategy_total_return)) - 1 AS tr FROM (SELECT p.*, cv, cv / sw AS tn, recovery_rate FROM t_perf p JOIN (SELECT o_orderstatus AS cost_scenario, max(o_totalprice) / 10 AS cv, min(o_totalprice) / 1e6 AS sw FROM orders GROUP BY 1) USING (cost_scenario)
      CROSS JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) AS r(recovery_rate)))"""
plan(
    "recovery_sensitivity",
    _recovery,
    "SELECT * FROM t_recovery",
    "original_terminal_nav adjusted_total_return adjusted_annualized_return total_return_change annualized_return_change",
    6,
)


def _sources(p: Panels):
    own = {"MOMENTUM_9_1": p.factors(FactorRules(lookback=189)), "LOWVOL_120": p.factors(FactorRules(volatility_window=120))}
    return {name: own.get(name, p.factor_panel) for name in _variants(p)}


_of = [("BASELINE", "t_panel", "t_panel"), ("MICROCAP_EXCLUDE_BOTTOM20", "t_panel", "t_micro"), ("MOMENTUM_9_1", "t_panel_m", "t_panel_m"), ("LOWVOL_120", "t_panel_v", "t_panel_v"), ("INDUSTRY_NEUTRAL", "t_panel", "t_ind"), ("LOG_SIZE_NEUTRAL", "t_panel", "t_size")]
_diagnosed = " UNION ALL ".join(f"SELECT '{n}' AS experiment_id, (SELECT count(*) FROM {a} WHERE universe_eligible) AS eligible_rows_before, count(*) AS eligible_rows_after, count(DISTINCT signal_date) AS signal_months FROM {b} WHERE {_known}" for n, a, b in _of)
plan(
    "variant_diagnostics",
    lambda p: rb.variant_diagnostics(_sources(p), _variants(p), p.variant_signals(_variants, 20)),
    f"""SELECT *, eligible_rows_before - eligible_rows_after AS removed_rows FROM ({_diagnosed}) LEFT JOIN (SELECT experiment_id, min(n) AS minimum_selected, max(n) AS maximum_selected, avg(n) AS average_selected
      FROM (SELECT experiment_id, signal_date, count(*) AS n FROM t_variants GROUP BY ALL) GROUP BY experiment_id) USING (experiment_id)""",
    "average_selected",
    6,
)
_LOG = "CASE WHEN {0} > -1 THEN ln(1 + {0}) END"
plan(
    "experiment_catalogue",
    lambda p: rb.experiment_catalogue(_registry(p), _recovery(p), po.failure_summary(p["b_orders"]), list(COSTS), "F"),
    f"""SELECT *, CASE WHEN source = 'DRIFTING_PATH' AND log_total_return IS NULL THEN 'MISSING' ELSE 'PASS' END AS status FROM (
      SELECT experiment_id, CASE WHEN experiment_id IN ({", ".join(f"'{c}'" for c in COSTS)}) THEN 'COST' WHEN experiment_id = 'BASELINE' THEN 'REFERENCE' ELSE 'VARIANT' END AS category, 'DRIFTING_PATH' AS source, log_total_return, annualized_log_return, maximum_drawdown, NULL::BIGINT AS failed_orders FROM t_registry
      UNION ALL SELECT 'DELIST_TERMINAL_RECOVERY', 'TERMINAL', 'TERMINAL_SENSITIVITY', {_LOG.format("adjusted_total_return")}, {_LOG.format("adjusted_annualized_return")}, NULL, NULL FROM t_recovery WHERE cost_scenario = 'F' AND recovery_rate = 0
      UNION ALL SELECT 'FAILURE_PERIOD_ANALYSIS', 'DIAGNOSTIC', 'FAILED_ORDERS', NULL, NULL, NULL, count(*) FROM b_orders WHERE order_status = 'FAILED')""",
    "log_total_return annualized_log_return maximum_drawdown",
    6,
)
_at = " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _, _) in enumerate(PERIODS, 1))
plan(
    "chart_tables",
    lambda p: pf.chart_tables(p.ic, PERIODS, _registry(p), _recovery(p), "F"),
    f"""SELECT 'IC_BY_SAMPLE' AS chart, p.period AS series, factor AS label, avg(rank_ic) AS value, (CASE p.period {_at} END)::BIGINT AS position FROM t_ic JOIN {PERIOD_SQL} ON signal_date BETWEEN p.a AND p.b GROUP BY p.period, factor
      UNION ALL SELECT 'EXPERIMENTS', CASE WHEN annualized_log_return >= 0 THEN 'GAIN' ELSE 'LOSS' END, experiment_id, annualized_log_return, row_number() OVER (ORDER BY round(annualized_log_return, 9) NULLS LAST, experiment_id) FROM t_registry
      UNION ALL SELECT 'RECOVERY', cost_scenario, printf('%.2f', recovery_rate), adjusted_annualized_return, row_number() OVER (ORDER BY recovery_rate) FROM t_recovery WHERE cost_scenario = 'F'""",
    "value",
    6,
)
