"""Registered queries: data quality and reconciliation."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.operators import diagnostics as dg
from factorloom.operators import factors as fc
from factorloom.operators import performance as pf
from factorloom.operators import portfolio as po
from factorloom.operators import quality as qa
from factorloom.operators.portfolio import trade_costs
from factorloom.operators.quality import apart, differs
from factorloom.plans.accounts import RATIO, _action_rows, _gated, _ledger, _refs, _trades, _valued, action_rows_of
from factorloom.plans.panels import Panels, capital_of
from factorloom.plans.registry import plan
from factorloom.plans.twins import CUT, FACTORS, PANELS

BAR = ["ts_code", "trade_date"]


def _check_sql(category: str, checks: dict[str, tuple[str, str]]) -> str:
    """checks: id -> (source, condition that violates)."""
    return " UNION ALL ".join(f"SELECT '{k}' AS check_id, '{category}' AS category, count(*) AS observed, 0::BIGINT AS expected, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {s} WHERE {w}" for k, (s, w) in checks.items())


def _c(sql: str):
    return F.expr(sql)


_keys = {"daily_panel": ("t_daily", BAR), "execution_status": ("t_exec", BAR), "month_end_panel": ("t_month", ["ts_code", "signal_date"]), "factor_panel": ("t_panel", fc.KEY), "suspend_aggregate": ("t_suspend", BAR), "order_lines": ("b_orders", ["orderkey", "linenumber"])}
plan(
    "duplicate_keys",
    lambda p: qa.duplicate_keys({"daily_panel": (p.daily, BAR), "execution_status": (p.status, BAR), "month_end_panel": (p.monthly, ["ts_code", "signal_date"]), "factor_panel": (p.factor_panel, fc.KEY), "suspend_aggregate": (p.suspended, BAR), "order_lines": (p["b_orders"], ["orderkey", "linenumber"])}),
    _check_sql("KEY_UNIQUENESS", {k: (f"(SELECT count(*) AS n FROM {t} GROUP BY {', '.join(key)})", "n > 1") for k, (t, key) in _keys.items()}),
)
plan(
    "key_coverage",
    lambda p: qa.all_checks([qa.missing_keys(p["b_daily"], p["b_adj"], BAR, "daily_without_adj_factor"), qa.missing_keys(p["b_daily"], p.daily, BAR, "daily_not_in_panel"), qa.missing_keys(p["b_daily"], p["b_stock_basic"], ["ts_code"], "codes_without_listing"), qa.missing_keys(p["b_suspend"], p["b_daily"], BAR, "suspensions_without_bar")]),
    _check_sql(
        "KEY_COVERAGE",
        {
            "daily_without_adj_factor": ("(SELECT DISTINCT ts_code, trade_date FROM b_daily) k", "NOT EXISTS (SELECT 1 FROM b_adj x WHERE x.ts_code = k.ts_code AND x.trade_date = k.trade_date)"),
            "daily_not_in_panel": ("(SELECT DISTINCT ts_code, trade_date FROM b_daily) k", "NOT EXISTS (SELECT 1 FROM t_daily x WHERE x.ts_code = k.ts_code AND x.trade_date = k.trade_date)"),
            "codes_without_listing": ("(SELECT DISTINCT ts_code FROM b_daily) k", "NOT EXISTS (SELECT 1 FROM b_stock_basic x WHERE x.ts_code = k.ts_code)"),
            "suspensions_without_bar": ("(SELECT DISTINCT ts_code, trade_date FROM b_suspend) k", "NOT EXISTS (SELECT 1 FROM b_daily x WHERE x.ts_code = k.ts_code AND x.trade_date = k.trade_date)"),
        },
    ),
)
plan(
    "key_symmetric_diff",
    lambda p: qa.key_symmetric_diff(p["b_daily"], p["b_suspend"], BAR),
    "SELECT ts_code, trade_date, 'LEFT_ONLY' AS side FROM (SELECT ts_code, trade_date FROM b_daily EXCEPT SELECT ts_code, trade_date FROM b_suspend) UNION ALL SELECT ts_code, trade_date, 'RIGHT_ONLY' FROM (SELECT ts_code, trade_date FROM b_suspend EXCEPT SELECT ts_code, trade_date FROM b_daily)",
)
_ends = "coalesce(effective_to, DATE '9999-12-31')"
_pairs_of = "(SELECT x.ts_code FROM (SELECT *, row_number() OVER () AS k, {e} AS e FROM {t}) x JOIN (SELECT *, row_number() OVER () AS k, {e} AS e FROM {t}) y ON x.ts_code = y.ts_code AND x.k < y.k AND x.effective_from <= y.e AND y.effective_from <= x.e WHERE x.effective_from <= x.e AND y.effective_from <= y.e)"
plan(
    "interval_overlap",
    lambda p: qa.all_checks([qa.interval_overlap(p.industry, "industry"), qa.interval_overlap(p.names, "name")]),
    _check_sql("INTERVALS", {k: v for n, t in (("industry", "t_industry"), ("name", "t_name")) for k, v in ((f"{n}_overlaps", (_pairs_of.format(t=t, e=_ends), "true")), (f"{n}_reversed", (t, "effective_to < effective_from")))}),
)
plan(
    "panel_profile",
    lambda p: qa.panel_profile(p.daily),
    "SELECT count(*) AS row_count, count(DISTINCT ts_code) AS codes, count(DISTINCT (ts_code, trade_date)) AS distinct_keys, min(trade_date) AS minimum_date, max(trade_date) AS maximum_date, count(*) FILTER (WHERE canonical_ts_code IS NULL) AS missing_canonical, count(*) FILTER (WHERE NOT is_within_listing_window) AS outside_listing_rows, count(*) FILTER (WHERE NOT security_code_interval_valid) AS invalid_interval_rows, min(trade_date) FILTER (WHERE is_sh_sz) AS minimum_sh_sz_date FROM t_daily",
)


def _reconcile(p: Panels):
    cut = CUT
    old = fc.factor_panel(p.monthly.where(F.col("signal_date") <= cut), p.daily.where(F.col("trade_date") <= cut)).select(*fc.KEY, "universe_eligible", *FACTORS)
    return qa.prefix_reconcile(old, p.factor_panel.where(F.col("signal_date") <= cut), fc.KEY, ["universe_eligible"], list(FACTORS), 1e-9).select("*").withColumn("maximum_numeric_error", F.round("maximum_numeric_error", 6))


_gap = "greatest(" + ", ".join(f"coalesce(max(abs(o.{f} - n.{f})), 0)" for f in FACTORS) + ")"
plan(
    "prefix_reconcile",
    _reconcile,
    f"""SELECT *, CASE WHEN missing_or_extra_rows = 0 AND categorical_mismatches = 0 AND maximum_numeric_error <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT count(o.signal_date) AS old_rows, count(n.signal_date) AS new_rows, count(*) FILTER (WHERE o.signal_date IS NULL OR n.signal_date IS NULL) AS missing_or_extra_rows,
        count(*) FILTER (WHERE o.signal_date IS NOT NULL AND n.signal_date IS NOT NULL AND o.universe_eligible IS DISTINCT FROM n.universe_eligible) AS categorical_mismatches, {_gap} AS maximum_numeric_error
      FROM t_panel_c o FULL JOIN (SELECT * FROM t_panel WHERE signal_date <= DATE '{CUT}') n ON o.canonical_ts_code = n.canonical_ts_code AND o.signal_date = n.signal_date)""",
    "maximum_numeric_error",
    6,
)


def _account_prefix(p: Panels):
    early = lambda df: df.where(F.col("trade_date") <= CUT)
    orders, market, key = early(p["b_orders"]), early(p["b_benchmark"]), ["portfolio_id", "suppkey"]
    valued = po.stale_valuation(po.position_ledger(orders, key), early(p["b_daily"]), market, key, "suppkey")
    # Both runs begin with the cash that the earlier one can know of.
    capital = capital_of(orders)
    old = po.account_daily(orders, valued, market, p["b_scenarios"], p["b_fees"], capital)
    new = po.account_daily(p["b_orders"], p.stale, p["b_benchmark"], p["b_scenarios"], p["b_fees"], capital)
    out = qa.prefix_reconcile(old, early(new), ["portfolio_id", "cost_scenario", "trade_date"], _whole, _shares, 1e-9)
    return out.withColumn("maximum_numeric_error", F.round("maximum_numeric_error", 6))


_whole, _shares = ["holding_count", "stale_position_count", "failed_buy_orders", "failed_sell_orders"], ["strategy_nav", "cash_weight", "stale_weight", "turnover_ratio"]
_early = {"b_orders": "t_orders_c", "b_daily": "t_bars_c", "b_benchmark": "t_market_c"}
PANELS |= {made: f"SELECT * FROM {b} WHERE trade_date <= DATE '{CUT}'" for b, made in _early.items()}
_path = ["t_ledger", "t_marks", "t_stale", "t_flow", "t_capital", "t_mark", "t_acc0", "t_acc1", "t_acc2", "t_acc"]
for _n in _path:  # the same steps from the earlier run's inputs
    PANELS[f"{_n}_c"] = re.sub(r"\b(" + "|".join([*_path, *_early]) + r")\b", lambda m: _early.get(m[0], f"{m[0]}_c"), PANELS[_n])
for _n in _path[-4:]:  # and from all inputs with the earlier run's capital
    PANELS[f"{_n}_n"] = re.sub(r"\b(t_capital|t_acc[012])\b", lambda m: "t_capital_c" if m[0] == "t_capital" else f"{m[0]}_n", PANELS[_n])
plan(
    "prefix_reconcile_accounts",
    _account_prefix,
    f"""SELECT *, CASE WHEN missing_or_extra_rows = 0 AND categorical_mismatches = 0 AND maximum_numeric_error <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT count(o.trade_date) AS old_rows, count(n.trade_date) AS new_rows, count(*) FILTER (WHERE o.trade_date IS NULL OR n.trade_date IS NULL) AS missing_or_extra_rows,
        count(*) FILTER (WHERE o.trade_date IS NOT NULL AND n.trade_date IS NOT NULL AND ({" OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in _whole)})) AS categorical_mismatches,
        round(greatest({", ".join(f"coalesce(max(abs(o.{c} - n.{c})), 0)" for c in _shares)}), 6) AS maximum_numeric_error
      FROM t_acc_c o FULL JOIN (SELECT * FROM t_acc_n WHERE trade_date <= DATE '{CUT}') n ON o.portfolio_id = n.portfolio_id AND o.cost_scenario = n.cost_scenario AND o.trade_date = n.trade_date)""",
    "maximum_numeric_error",
    6,
)


def _holdings_prefix(p: Panels):
    early = lambda df: df.where(F.col("trade_date") <= CUT)
    key = ["portfolio_id", "suppkey"]
    old, new = ((po.position_ledger(orders, key), po.closes(bars, "suppkey")) for orders, bars in ((early(p["b_orders"]), early(p["b_daily"])), (p["b_orders"], p["b_daily"])))
    out = qa.reconciled_holdings(old, new, early(p["b_benchmark"]), key, "suppkey", 1e-6)
    return out.withColumn("maximum_numeric_error", F.round("maximum_numeric_error", 4))


plan(
    "prefix_reconcile_holdings",
    _holdings_prefix,
    f"""SELECT *, CASE WHEN missing_or_extra_rows = 0 AND categorical_mismatches = 0 AND maximum_numeric_error <= 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT count(o.trade_date) AS old_rows, count(n.trade_date) AS new_rows, count(*) FILTER (WHERE o.trade_date IS NULL OR n.trade_date IS NULL) AS missing_or_extra_rows,
        count(*) FILTER (WHERE o.trade_date IS NOT NULL AND n.trade_date IS NOT NULL AND (o.price_source IS DISTINCT FROM n.price_source OR o.stale_calendar_days IS DISTINCT FROM n.stale_calendar_days)) AS categorical_mismatches,
        round(greatest(coalesce(max(abs(o.units - n.units)), 0), coalesce(max(abs(o.price - n.price)), 0), coalesce(max(abs(o.market_value - n.market_value)), 0)), 4) AS maximum_numeric_error
      FROM t_stale_c o FULL JOIN (SELECT * FROM t_stale WHERE trade_date <= DATE '{CUT}') n ON o.portfolio_id = n.portfolio_id AND o.suppkey = n.suppkey AND o.trade_date = n.trade_date)""",
    "maximum_numeric_error",
    4,
)
def _actions_prefix(p: Panels):
    early = lambda df: df.where(F.col("trade_date") <= CUT)
    old = action_rows_of(early(_trades(p)), po.corporate_action_refs(p["b_code_history"], early(p.daily), RATIO))
    out = qa.prefix_reconcile(old, early(_action_rows(p)), ["portfolio_id", "ts_code", "trade_date", "activity"], ["successor_was_held"], ["units_traded", "carry_price"], 1e-9)
    return out.withColumn("maximum_numeric_error", F.round("maximum_numeric_error", 6))


for _n in ("t_trades", "t_refs", "t_action", "t_action_rows"):  # the same steps from the earlier run's inputs
    PANELS[f"{_n}_c"] = re.sub(r"\b(t_trades|t_refs|t_action|b_orders)\b", lambda m: "t_orders_c" if m[0] == "b_orders" else f"{m[0]}_c", PANELS[_n]).replace("JOIN t_daily ", f"JOIN (SELECT * FROM t_daily WHERE trade_date <= DATE '{CUT}') ").replace("FROM t_daily d ", f"FROM (SELECT * FROM t_daily WHERE trade_date <= DATE '{CUT}') d ")
_same = "o.portfolio_id = n.portfolio_id AND o.ts_code = n.ts_code AND o.trade_date = n.trade_date AND o.activity = n.activity"
plan(
    "prefix_reconcile_actions",
    _actions_prefix,
    f"""SELECT *, CASE WHEN missing_or_extra_rows = 0 AND categorical_mismatches = 0 AND maximum_numeric_error <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT count(o.trade_date) AS old_rows, count(n.trade_date) AS new_rows, count(*) FILTER (WHERE o.trade_date IS NULL OR n.trade_date IS NULL) AS missing_or_extra_rows,
        count(*) FILTER (WHERE o.trade_date IS NOT NULL AND n.trade_date IS NOT NULL AND o.successor_was_held IS DISTINCT FROM n.successor_was_held) AS categorical_mismatches,
        round(greatest(coalesce(max(abs(o.units_traded - n.units_traded)), 0), coalesce(max(abs(o.carry_price - n.carry_price)), 0)), 6) AS maximum_numeric_error
      FROM t_action_rows_c o FULL JOIN (SELECT * FROM t_action_rows WHERE trade_date <= DATE '{CUT}') n ON {_same})""",
    "maximum_numeric_error",
    6,
)
_formula = {
    "close_hfq_is_close_times_factor": ("t_daily", "abs(close_hfq - close * adj_factor) > 1e-8"),
    "volume_is_in_shares": ("t_daily", "abs(volume_share - vol * 100) > 1e-6"),
    "amount_is_in_currency": ("t_daily", "abs(amount_cny - amount * 1000) > 1e-4"),
    "market_value_is_in_currency": ("t_month", "abs(total_mv_cny - total_mv * 10000) > 1e-4"),
    "value_is_inverse_pb": ("t_panel", "(pb > 0) <> (bm_proxy IS NOT NULL) OR abs(bm_proxy * pb - 1) > 1e-9"),
    "winsorized_within_limits": ("t_panel", "universe_eligible AND (momentum_12_1_winsorized < momentum_12_1_p01 - 1e-12 OR momentum_12_1_winsorized > momentum_12_1_p99 + 1e-12)"),
}
_tables = {"t_daily": lambda p: p.daily, "t_exec": lambda p: p.status, "t_month": lambda p: p.monthly, "t_panel": lambda p: p.factor_panel, "t_nav": lambda p: p.nav, "t_targets": lambda p: p.targets, "b_orders": lambda p: p["b_orders"]}


def _run(p: Panels, category: str, checks: dict[str, tuple[str, str]]):
    frames = []
    for t in dict.fromkeys(s for s, _ in checks.values()):
        frames.append(qa.checks(_tables[t](p), category, {k: _c(w) for k, (s, w) in checks.items() if s == t}))
    return qa.all_checks(frames)


# Once more, by numbers of bars (the deviation of returns as a variance).
PANELS |= {
    "t_numbered": """SELECT *, coalesce(sum(r) OVER w, 0) AS s1, coalesce(sum(r * r) OVER w, 0) AS s2 FROM (SELECT canonical_ts_code, trade_date, close_hfq AS p, row_number() OVER v AS k, close_hfq / lag(close_hfq) OVER v - 1 AS r FROM t_daily
      WHERE is_sh_sz AND is_within_listing_window AND security_code_interval_valid AND close_hfq > 0 WINDOW v AS (PARTITION BY canonical_ts_code ORDER BY trade_date)) WINDOW w AS (PARTITION BY canonical_ts_code ORDER BY trade_date)""",
    "t_again": """SELECT f.*, x.p / y.p - 1 AS want_momentum, greatest((n.s2 - b.s2) - (n.s1 - b.s1) * (n.s1 - b.s1) / 60, 0) / 59 AS want_variance, z.adjusted_price / f.adjusted_price - 1 AS want_label FROM t_panel f
      JOIN t_numbered n ON n.canonical_ts_code = f.canonical_ts_code AND n.trade_date = f.asof_trade_date
      LEFT JOIN t_numbered x ON x.canonical_ts_code = n.canonical_ts_code AND x.k = n.k - 21 LEFT JOIN t_numbered y ON y.canonical_ts_code = n.canonical_ts_code AND y.k = n.k - 252
      LEFT JOIN t_numbered b ON b.canonical_ts_code = n.canonical_ts_code AND b.k = n.k - 60
      LEFT JOIN t_panel z ON z.canonical_ts_code = f.canonical_ts_code AND year(z.signal_date) * 12 + month(z.signal_date) = year(f.signal_date) * 12 + month(f.signal_date) + 1""",
    "t_ranked": """SELECT signal_date, factor, next_month_return, n, round((percent_rank() OVER (PARTITION BY signal_date, factor ORDER BY z) * (n - 1) + 1 + cume_dist() OVER (PARTITION BY signal_date, factor ORDER BY z) * n)) / 2 AS a,
      round((percent_rank() OVER (PARTITION BY signal_date, factor ORDER BY label) * (n - 1) + 1 + cume_dist() OVER (PARTITION BY signal_date, factor ORDER BY label) * n)) / 2 AS b FROM (SELECT *, count(*) OVER (PARTITION BY signal_date, factor) AS n FROM t_eval WHERE z IS NOT NULL)""",
}
_again = {
    "momentum_from_bar_numbers": ("t_again", differs("momentum_12_1", "want_momentum", 1e-9)),
    "volatility_from_running_sums": ("t_again", differs("lowvol_60 * lowvol_60", "CASE WHEN volatility_observations = 60 THEN want_variance END", 1e-9)),
    "label_from_next_month": ("t_again", differs("next_month_return", "want_label", 1e-9)),
}


def _formulas(p: Panels):
    again = qa.rederived_factors(p.factor_panel, p.daily)
    return _run(p, "FORMULA", _formula).unionByName(qa.checks(again, "FORMULA", {k: _c(w) for k, (_, w) in _again.items()}))


plan("dq_formula", _formulas, _check_sql("FORMULA", _formula | _again))
_flags = {
    "listing_flag_without_reference": ("t_daily", "is_within_listing_window AND NOT has_listing_reference"),
    "age_outside_listing_window": ("t_daily", "listing_age_trading_days IS NOT NULL AND NOT is_within_listing_window"),
    "exchange_flag": ("t_daily", "is_sh_sz <> (ts_code LIKE '%.SH' OR ts_code LIKE '%.SZ')"),
    "buy_block_matches_reasons": ("t_exec", "cannot_buy_at_open <> (NOT has_daily_price OR suspended_at_open OR open_at_up_limit)"),
    "sell_block_matches_reasons": ("t_exec", "cannot_sell_at_open <> (NOT has_daily_price OR suspended_at_open OR open_at_down_limit)"),
    "block_without_reason": ("t_exec", "(cannot_buy_at_open OR cannot_sell_at_open) AND execution_block_reason IS NULL"),
    "suspended_at_open_without_s": ("t_exec", "suspended_at_open AND NOT has_suspend_s"),
    "history_flag": ("t_month", "has_enough_252d_history <> (available_history_observations >= 252)"),
    "eligible_outside_preuniverse": ("t_panel", "universe_eligible AND NOT universe_pre_liquidity"),
    "eligible_st": ("t_panel", "universe_eligible AND coalesce(is_st_name_flag, false)"),
}
plan("dq_flags", lambda p: _run(p, "FLAG_LOGIC", _flags), _check_sql("FLAG_LOGIC", _flags))
_ahead = {
    "bar_after_signal": ("t_month", "asof_trade_date > signal_date"),
    "factor_without_history": ("t_panel", "momentum_12_1 IS NOT NULL AND price_past IS NULL"),
    "volatility_of_short_window": ("t_panel", "lowvol_60 IS NOT NULL AND volatility_observations <> 60"),
    "universe_without_factors": ("t_panel", "universe_eligible AND (bm_proxy IS NULL OR momentum_12_1 IS NULL OR lowvol_60 IS NULL)"),
}
plan("dq_lookahead", lambda p: _run(p, "NO_LOOK_AHEAD", _ahead), _check_sql("NO_LOOK_AHEAD", _ahead))
_moments = "(SELECT signal_date, " + ", ".join(f"avg({f}_z) AS m_{f}, stddev_samp({f}_z) AS s_{f}, count({f}_z) AS n_{f}" for f in FACTORS) + " FROM t_panel GROUP BY signal_date)"
_zs = {f"{f}_{k}": (_moments, w.format(f)) for f in FACTORS for k, w in (("mean_is_zero", "n_{0} > 0 AND abs(m_{0}) > 1e-8"), ("deviation_is_one", "n_{0} > 1 AND abs(s_{0} - 1) > 1e-8"))}


def _zscores(p: Panels):
    aggregates = [x for f in FACTORS for x in (F.avg(f"{f}_z").alias(f"m_{f}"), F.stddev_samp(f"{f}_z").alias(f"s_{f}"), F.count(f"{f}_z").alias(f"n_{f}"))]
    return qa.checks(p.factor_panel.groupBy("signal_date").agg(*aggregates), "CROSS_SECTION", {k: _c(w) for k, (_, w) in _zs.items()})


plan("dq_zscore", _zscores, _check_sql("CROSS_SECTION", _zs))
_spread = "(SELECT signal_date, factor, max(mean_next_month_return) FILTER (WHERE quintile = 'Q5') - max(mean_next_month_return) FILTER (WHERE quintile = 'Q1') AS d, max(mean_next_month_return) FILTER (WHERE quintile = 'TOP_MINUS_BOTTOM') AS t FROM t_qr GROUP BY ALL)"
_stats = {"spread_is_top_less_bottom": (_spread, "abs(d - t) > 1e-12 OR (d IS NULL) <> (t IS NULL)"), "ic_within_bounds": ("t_ic", "abs(rank_ic) > 1 + 1e-9"), "ic_of_few_rows": ("t_ic", "rank_ic IS NOT NULL AND observations < 5")}


_quintile = "least(greatest(ceil(a * 5 / n), 1), 5)"
_stats |= {
    "ic_from_sums": ("(SELECT r.want, i.rank_ic FROM (SELECT signal_date, factor, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS want FROM t_ranked WHERE n >= 5 GROUP BY ALL) r LEFT JOIN t_ic i ON i.signal_date = r.signal_date AND i.factor = r.factor)", differs("want", "rank_ic", 1e-9)),
    "quintile_means": (f"(SELECT r.want, q.mean_next_month_return FROM (SELECT signal_date, factor, 'Q' || {_quintile}::INT AS quintile, avg(next_month_return) AS want FROM t_ranked WHERE n >= 5 GROUP BY ALL) r LEFT JOIN t_qr q ON q.signal_date = r.signal_date AND q.factor = r.factor AND q.quintile = r.quintile)", differs("want", "mean_next_month_return", 1e-9)),
}


def _statistics(p: Panels):
    pick = lambda q: F.max(F.when(F.col("quintile") == q, F.col("mean_next_month_return")))
    spread = p.quintiles.groupBy("signal_date", "factor").agg((pick("Q5") - pick("Q1")).alias("d"), pick("TOP_MINUS_BOTTOM").alias("t"))
    a = qa.checks(spread, "STATISTICS", {"spread_is_top_less_bottom": apart(F.col("d"), F.col("t"), 1e-12)})
    a = a.unionByName(qa.checks(p.ic, "STATISTICS", {k: _c(_stats[k][1]) for k in ("ic_within_bounds", "ic_of_few_rows")}))
    # Correlations and quintile means once more, from other ranks and another formula.
    by = ["signal_date", "factor"]
    rows = dg.evaluated(p.factor_panel).where("z is not null").withColumn("label", F.round("next_month_return", 9))
    ranked = rows.select(*by, "next_month_return", F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"), qa.mean_rank("z", by).alias("a"), qa.mean_rank("label", by).alias("b")).where("n >= 5")
    c = F.corr("a", "b")
    ic = ranked.groupBy(*by).agg(F.when(~F.isnan(c), c).alias("want")).join(p.ic, by, "left")
    means = ranked.groupBy(*by, F.expr(f"concat('Q', cast({_quintile} as int))").alias("quintile")).agg(F.avg("next_month_return").alias("want"))
    means = means.join(p.quintiles, [*by, "quintile"], "left")
    return a.unionByName(qa.checks(ic, "STATISTICS", {"ic_from_sums": _c(_stats["ic_from_sums"][1])})).unionByName(qa.checks(means, "STATISTICS", {"quintile_means": _c(_stats["quintile_means"][1])}))


plan("dq_statistics", _statistics, _check_sql("STATISTICS", _stats))
_grid_months = "SELECT DISTINCT signal_date FROM b_month_end"
plan(
    "factor_grid",
    lambda p: qa.cell_grid(dg.evaluated(p.factor_panel).where("z is not null"), "signal_date", "factor", list(FACTORS), p["b_month_end"]),
    f"SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {f} = 0 THEN '{f}' END" for f in FACTORS)}) AS missing FROM (SELECT m.signal_date, {', '.join(f"count(*) FILTER (WHERE factor = '{f}') AS {f}" for f in FACTORS)} FROM ({_grid_months}) m LEFT JOIN (SELECT * FROM t_long WHERE universe_eligible AND next_month_return IS NOT NULL AND z IS NOT NULL) x USING (signal_date) GROUP BY ALL)",
)
_tg = "(SELECT signal_date, count(*) AS n, sum(target_weight) AS w, max(target_weight) AS m, max(selection_rank) AS r, count(DISTINCT canonical_ts_code) AS u FROM t_targets GROUP BY signal_date)"
_target = {"more_than_k": (_tg, "n > 20"), "gross_above_one": (_tg, "w > 1 + 1e-9"), "name_above_cap": (_tg, "m > 0.02 + 1e-12"), "ranks_have_gaps": (_tg, "r <> n"), "code_twice": (_tg, "u <> n")}


def _target_checks(p: Panels):
    months = p.targets.groupBy("signal_date").agg(F.count(F.lit(1)).alias("n"), F.sum("target_weight").alias("w"), F.max("target_weight").alias("m"), F.max("selection_rank").alias("r"), F.count_distinct("canonical_ts_code").alias("u"))
    return qa.checks(months, "TARGETS", {k: _c(w) for k, (_, w) in _target.items()})


plan("dq_targets", _target_checks, _check_sql("TARGETS", _target))
_acc_l = "(SELECT l.*, o.u FROM t_ledger l JOIN (SELECT portfolio_id, suppkey, sum(CASE WHEN side = 'BUY' THEN executed_units ELSE -executed_units END) AS u, max(trade_date) AS d FROM b_orders GROUP BY ALL) o ON o.portfolio_id = l.portfolio_id AND o.suppkey = l.suppkey AND o.d = l.trade_date)"
_acc_c = """(SELECT a.cash, a.initial_capital, a.initial_capital + w.flow AS want FROM (SELECT portfolio_id, cost_scenario, initial_capital, max_by(cash, trade_date) AS cash FROM t_acc GROUP BY ALL) a JOIN
  (SELECT portfolio_id, cost_scenario, sum(CASE WHEN side = 'BUY' THEN -executed_notional ELSE executed_notional END - commission_cost - coalesce(stamp_duty_cost, 0)) AS flow FROM t_costs GROUP BY ALL) w USING (portfolio_id, cost_scenario))"""
_account = {"last_units_are_sum_of_fills": (_acc_l, "abs(units_after - u) > 1e-6"), "value_is_units_times_price": ("t_valued", "abs(current_value - units * price) > 1e-6"), "account_cash_is_sum_of_flows": (_acc_c, "abs(cash - want) > 1e-9 * initial_capital"), "account_nav_is_cash_and_value": ("t_acc", "abs(total_nav - cash - market_value) > 1e-9 * initial_capital OR abs(strategy_nav * initial_capital - total_nav) > 1e-9 * initial_capital"), "nav_starts_at_one": ("(SELECT cost_scenario, min_by(strategy_nav, trade_date) AS f FROM t_nav GROUP BY 1)", "abs(f - 1) > 1e-12")}


def _accounting(p: Panels):
    totals = p["b_orders"].groupBy("portfolio_id", "suppkey").agg(F.sum(F.when(F.col("side") == "BUY", F.col("executed_units")).otherwise(-F.col("executed_units"))).alias("u"), F.max("trade_date").alias("trade_date"))
    first = p.nav.groupBy("cost_scenario").agg(F.min_by("strategy_nav", "trade_date").alias("f"))
    # Cash once more, from single orders and not from sums by day.
    paid = F.when(F.col("side") == "BUY", -F.col("executed_notional")).otherwise(F.col("executed_notional")) - F.col("commission_cost") - F.coalesce("stamp_duty_cost", F.lit(0.0))
    flow = trade_costs(p["b_orders"], p["b_scenarios"], p["b_fees"]).groupBy(*pf.ACCOUNT).agg(F.sum(paid).alias("flow"))
    cash = p.accounts.groupBy(*pf.ACCOUNT, "initial_capital").agg(F.max_by("cash", "trade_date").alias("cash")).join(flow, pf.ACCOUNT).withColumn("want", F.col("initial_capital") + F.col("flow"))
    frames = (_ledger(p).join(totals, ["portfolio_id", "suppkey", "trade_date"]), _valued(p), cash, p.accounts, first)
    return qa.all_checks([qa.checks(f, "ACCOUNTING", {k: _c(w)}) for f, (k, (_, w)) in zip(frames, _account.items(), strict=True)])


plan("dq_accounting", _accounting, _check_sql("ACCOUNTING", _account))
_exe = {
    "failed_order_executed": ("b_orders", "order_status = 'FAILED' AND (executed_notional <> 0 OR executed_units <> 0)"),
    "failed_order_without_reason": ("b_orders", "order_status = 'FAILED' AND failure_reason = ''"),
    "reason_without_failure": ("b_orders", "order_status <> 'FAILED' AND failure_reason <> ''"),
    "executed_above_desired": ("b_orders", "executed_notional > desired_notional + 1e-6"),
}
_legal = "(SELECT o.*, e.* EXCLUDE (suppkey, trade_date) FROM t_gated o LEFT JOIN (SELECT x.trade_date, x.has_daily_price, x.cannot_buy_at_open, x.cannot_sell_at_open, c.suppkey FROM t_exec x JOIN (SELECT DISTINCT ts_code, suppkey FROM b_daily) c USING (ts_code)) e ON e.suppkey = o.suppkey AND e.trade_date = o.trade_date)"
_gates = {
    "planned_without_price": (_legal, "order_status = 'PLANNED' AND NOT coalesce(has_daily_price, false)"),
    "planned_buy_blocked": (_legal, "order_status = 'PLANNED' AND side = 'BUY' AND coalesce(cannot_buy_at_open, true)"),
    "planned_sell_blocked": (_legal, "order_status = 'PLANNED' AND side = 'SELL' AND coalesce(cannot_sell_at_open, true)"),
    "failed_without_block": (_legal, "order_status = 'FAILED' AND has_daily_price AND NOT CASE WHEN side = 'BUY' THEN cannot_buy_at_open ELSE cannot_sell_at_open END"),
}


_kept = {
    "failed_sell_not_held": ("""(SELECT l.units_after, h.units FROM (SELECT portfolio_id, suppkey, trade_date, arg_max(side || '_' || order_status, (orderkey, linenumber, partkey)) AS last_order FROM b_orders GROUP BY ALL) o
      JOIN t_ledger l ON l.portfolio_id = o.portfolio_id AND l.suppkey = o.suppkey AND l.trade_date = o.trade_date LEFT JOIN t_stale h ON h.portfolio_id = o.portfolio_id AND h.suppkey = o.suppkey AND h.trade_date = o.trade_date WHERE last_order = 'SELL_FAILED' AND l.units_after > 1e-12)""", "units IS NULL OR abs(units - units_after) > 1e-8")
}
_moved = {
    "failed_sells_moved_units": ("b_orders", "side = 'SELL' AND order_status = 'FAILED' AND (executed_units <> 0 OR executed_notional <> 0)"),
    "blocked_buys_above_cash": ("""(SELECT b.n * (1 + s.commission_rate) AS reserved, a.cash FROM (SELECT portfolio_id, trade_date, sum(desired_notional) AS n FROM b_orders WHERE side = 'BUY' AND order_status = 'FAILED' GROUP BY ALL) b CROSS JOIN b_scenarios s
      LEFT JOIN t_acc a ON a.portfolio_id = b.portfolio_id AND a.trade_date = b.trade_date AND a.cost_scenario = s.cost_scenario)""", "coalesce(cash + 0.01 < reserved, true)"),
}


def _execution(p: Panels):
    codes = p["b_daily"].select("ts_code", "suppkey").distinct()
    status = p.status.select("ts_code", "trade_date", "has_daily_price", "cannot_buy_at_open", "cannot_sell_at_open").join(codes, "ts_code").drop("ts_code")
    legal = qa.checks(_gated(p).join(status, ["suppkey", "trade_date"], "left"), "EXECUTION", {k: _c(w) for k, (_, w) in _gates.items()})
    # A position whose last order of the day is a failed sell is held at the day's end as it was.
    last = p["b_orders"].groupBy("portfolio_id", "suppkey", "trade_date").agg(F.max_by(F.concat_ws("_", "side", "order_status"), F.struct("orderkey", "linenumber", "partkey")).alias("last_order"))
    day = ["portfolio_id", "suppkey", "trade_date"]
    kept = last.where("last_order = 'SELL_FAILED'").join(_ledger(p).where("units_after > 1e-12"), day).join(po.held_from(_ledger(p), p["b_benchmark"], day[:2]), day, "left")
    held = qa.checks(kept, "EXECUTION", {k: _c(w) for k, (_, w) in _kept.items()})
    runs = po.failed_sell_runs(p["b_orders"], ["portfolio_id", "suppkey"], ["trade_date", "orderkey", "linenumber", "partkey"])
    moved = qa.checks(runs, "EXECUTION", {"failed_sells_moved_units": ~F.col("units_preserved")})
    reserved = qa.checks(po.reserved_cash(p["b_orders"], p.accounts, p["b_scenarios"]), "EXECUTION", {"blocked_buys_above_cash": F.col("is_violated")})
    return qa.all_checks([_run(p, "EXECUTION", _exe), legal, held, moved, reserved])


plan("dq_execution", _execution, _check_sql("EXECUTION", _exe | _gates | _kept | _moved))
_nav2 = "(SELECT cost_scenario, trade_date, strategy_nav, benchmark_nav, strategy_drawdown, relative_nav, strategy_nav / lag(strategy_nav) OVER (PARTITION BY cost_scenario ORDER BY trade_date) - 1 AS r, strategy_daily_return FROM t_nav)"
_derived = "(SELECT portfolio_id, cost_scenario, min_by(strategy_nav, trade_date) * product(1 + strategy_daily_return) AS grown, max_by(strategy_nav, trade_date) AS strategy_nav_end FROM t_acc GROUP BY ALL)"
_by_rate = "(SELECT cash, lag(cash) OVER (PARTITION BY portfolio_id ORDER BY commission_rate) AS before FROM (SELECT portfolio_id, commission_rate, max_by(cash, trade_date) AS cash FROM t_acc JOIN b_scenarios USING (cost_scenario) GROUP BY ALL))"
_perf = {
    "returns_follow_nav": (_nav2, "abs(r - strategy_daily_return) > 1e-10"),
    "drawdown_not_positive": (_nav2, "strategy_drawdown > 1e-12"),
    "relative_nav_is_ratio": (_nav2, "abs(relative_nav - strategy_nav / benchmark_nav) > 1e-10"),
    "total_return_not_of_daily_returns": (_derived, "abs(grown - strategy_nav_end) > 1e-8 * strategy_nav_end"),
    "higher_rate_with_higher_cash": (_by_rate, "cash > before * (1 + 1e-12)"),
    "costs_not_monotone": ("(SELECT c, lag(c) OVER (ORDER BY rate) AS before FROM (SELECT commission_rate AS rate, sum(commission_cost) AS c FROM t_costs GROUP BY 1))", "c < before"),
}


def _performance(p: Panels):
    nav = p.nav.withColumn("r", F.col("strategy_nav") / F.lag("strategy_nav").over(Window.partitionBy("cost_scenario").orderBy("trade_date")) - 1)
    costs = trade_costs(p["b_orders"], p["b_scenarios"], p["b_fees"]).groupBy("commission_rate").agg(F.sum("commission_cost").alias("c"))
    costs = costs.withColumn("before", F.lag("c").over(Window.orderBy("commission_rate")))  # a row for each scenario
    ends = p.accounts.groupBy(*pf.ACCOUNT).agg((F.min_by("strategy_nav", "trade_date") * F.product(1 + F.col("strategy_daily_return"))).alias("grown"), F.max_by("strategy_nav", "trade_date").alias("strategy_nav_end"), F.max_by("cash", "trade_date").alias("cash"))
    rates = ends.join(p["b_scenarios"], "cost_scenario").withColumn("before", F.lag("cash").over(Window.partitionBy("portfolio_id").orderBy("commission_rate")))
    a = qa.checks(nav, "PERFORMANCE", {k: _c(w) for k, (_, w) in list(_perf.items())[:3]})
    a = a.unionByName(qa.checks(rates, "PERFORMANCE", {k: _c(_perf[k][1]) for k in ("total_return_not_of_daily_returns", "higher_rate_with_higher_cash")}))
    return a.unionByName(qa.checks(costs, "PERFORMANCE", {"costs_not_monotone": _c("c < before")}))


plan("dq_performance", _performance, _check_sql("PERFORMANCE", _perf))
_code = {
    "old_code_valid_after_change": ("t_daily", "security_code_role = 'OLD_CODE' AND security_code_interval_valid AND trade_date >= effective_date"),
    "new_code_valid_before_change": ("t_daily", "security_code_role = 'NEW_CODE' AND security_code_interval_valid AND trade_date < effective_date"),
    "unmapped_code_invalid": ("t_daily", "security_code_role IS NULL AND NOT security_code_interval_valid"),
    "mapped_code_without_canonical": ("t_daily", "security_code_role IS NOT NULL AND canonical_ts_code IS NULL"),
}
plan("code_interval_violations", lambda p: _run(p, "CODE_MAPPING", _code), _check_sql("CODE_MAPPING", _code))
_term = "SELECT portfolio_id, suppkey, units_after AS units, (SELECT max(trade_date) FROM b_daily) AS terminal_date, last_bar, ((SELECT max(trade_date) FROM b_daily) - last_bar)::INT AS stale_calendar_days FROM (SELECT portfolio_id, suppkey, max_by(units_after, trade_date) AS units_after FROM t_ledger GROUP BY ALL) LEFT JOIN (SELECT suppkey, max(trade_date) AS last_bar FROM b_daily GROUP BY 1) USING (suppkey) WHERE units_after > 1e-12 AND last_bar < (SELECT max(trade_date) FROM b_daily)"


def _terminal(p: Panels):
    held = _ledger(p).groupBy("portfolio_id", "suppkey").agg(F.max_by("units_after", "trade_date").alias("units")).where("units > 1e-12")
    bars = p["b_daily"].groupBy("suppkey").agg(F.max("trade_date").alias("last_bar"))
    end = p["b_daily"].agg(F.max("trade_date").alias("terminal_date"))
    rows = held.join(bars, "suppkey", "left").join(end).where("last_bar < terminal_date")
    return rows.select("portfolio_id", "suppkey", "units", "terminal_date", "last_bar", F.date_diff("terminal_date", "last_bar").alias("stale_calendar_days"))


plan("terminal_holdings_check", _terminal, _term, "units", 4)
_ca = {
    "old_bar_not_before_effective": ("t_refs", "old_last_date >= effective_date"),
    "successor_before_effective": ("t_refs", "successor_first_date < effective_date"),
    "price_not_positive": ("t_refs", "NOT (old_close > 0 AND successor_open > 0)"),
    "factor_not_positive": ("t_refs", "NOT (old_factor > 0 AND successor_factor > 0)"),
    "inconsistent_adjusted_price": ("t_refs", "NOT is_consistent"),
    "ratio_not_positive": ("t_refs", "NOT conversion_ratio > 0"),
    "code_unchanged": ("t_refs", "old_ts_code = new_ts_code"),
}
plan("corporate_action_checks", lambda p: qa.checks(_refs(p), "CORPORATE_ACTION", {k: _c(w) for k, (_, w) in _ca.items()}), _check_sql("CORPORATE_ACTION", _ca))
