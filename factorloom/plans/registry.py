"""All registered queries of the factor-research operators, each beside its SQL twin.

Doubles are rounded on both sides, as the engines' sums differ in the last bits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.stats import OFFSET, rounded
from factorloom.operators import diagnostics as dg
from factorloom.operators import factors as fc
from factorloom.operators import panel as pn
from factorloom.operators import performance as pf
from factorloom.operators import portfolio as po
from factorloom.operators import quality as qa
from factorloom.operators import robustness as rb
from factorloom.plans.panels import Panels, panels
from factorloom.plans.twins import FACTORS, twin
from factorloom.sources import fingerprints as fp
from factorloom.sources import tables as src


@dataclass(frozen=True)
class Plan:
    build: Callable[[Panels], DataFrame]
    sql: str | None
    doubles: str
    digits: int


PLANS: dict[str, Plan] = {}


def plan(name: str, build: Callable[[Panels], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 8) -> None:
    PLANS[name] = Plan(build, sql, doubles, digits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, p=p: rounded(p.build(panels(spark, sf_dir)), p.digits)) for n, p in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for n, p in PLANS.items():
        if p.sql:
            replaced = ", ".join(f"floor({c}::DOUBLE * 1e{p.digits} + {OFFSET}) / 1e{p.digits} AS {c}" for c in p.doubles.split())
            out[n] = twin(f"SELECT * REPLACE ({replaced}) FROM ({p.sql})" if replaced else p.sql)
    return out


KEY = "canonical_ts_code, signal_date"
PERIODS = [("RESEARCH", "1995-01-01", "1997-12-31"), ("VALIDATION", "1998-01-01", "1999-12-31"), ("OOS", "2000-01-01", "2001-12-31")]
PERIOD_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + ") AS p(period, a, b)"

# Sources
plan(
    "scan_union_by_name",
    lambda p: src.scan_union_by_name([p["events"].where("event_id % 2 = 0").select("event_id", "event_type", "value"), p["events"].where("event_id % 2 = 1").select("event_type", "event_id")]).select("event_id", "event_type", "value"),
    "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events",
    "value",
)
plan(
    "input_inventory",
    lambda p: src.input_inventory({"lineitem": (p["lineitem"], "l_shipdate"), "orders": (p["orders"], "o_orderdate"), "events": (p["events"], "ts"), "supplier": (p["supplier"], None), "documents": (p["documents"].select("doc_id"), None)}),
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS row_count, min({d}) AS minimum_date, max({d}) AS maximum_date, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {t}"
        for t, d in (("lineitem", "CAST(l_shipdate AS DATE)"), ("orders", "CAST(o_orderdate AS DATE)"), ("events", "CAST(ts AS DATE)"), ("supplier", "CAST(NULL AS DATE)"), ("documents", "CAST(NULL AS DATE)"))
    ),
)
# Columns of the tables: whole numbers and texts plainly, #fraction, @time, *list of fractions.
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey #c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey #s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size #p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus #o_totalprice @o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber #l_quantity #l_extendedprice #l_discount #l_tax l_returnflag l_linestatus @l_shipdate",
    "events": "event_id @ts user_id event_type #value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id *embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _text_sql(column: str) -> str:
    c = column.lstrip("#@*")
    text = {
        "#": f"floor({c} * 1000000)::BIGINT::VARCHAR",
        "@": f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
        "*": f"array_to_string([floor(x::DOUBLE * 1000000)::BIGINT::VARCHAR for x in {c}], ',')",
    }.get(column[0], f"{c}::VARCHAR")
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE md5({text}) END"


def _fingerprint_sql(table: str) -> str:
    parts = " || '-' || ".join(f"coalesce(sum(('0x' || substr(h, {at}, 8))::BIGINT), 0)::VARCHAR" for at in (1, 9))
    return f"SELECT '{table}' AS \"table\", count(*) AS row_count, {parts} AS content_hash FROM (SELECT md5(concat_ws('|', {', '.join(map(_text_sql, COLUMNS[table].split()))})) AS h FROM {table})"


plan("table_fingerprint", lambda p: src.table_fingerprint({t: p[t] for t in COLUMNS}), " UNION ALL ".join(map(_fingerprint_sql, COLUMNS)))
plan("file_fingerprint", lambda p: fp.file_hashes(p.spark, f"{p.sf_dir}/*.parquet").withColumn("path", F.element_at(F.split("path", "/"), -1)))

# Panels
plan("trading_calendar", lambda p: p.calendar, "SELECT * FROM t_calendar")
plan("code_identity", lambda p: p.identity.select("ts_code", "canonical_ts_code", "security_code_role", "effective_date"), "SELECT ts_code, canonical_ts_code, security_code_role, effective_date FROM t_identity")
_meta = "ts_code, canonical_ts_code, list_date, listing_start_open_day, listing_age_is_lower_bound, has_listing_reference"
plan("listing_age", lambda p: p.meta.select(*_meta.split(", ")), f"SELECT {_meta} FROM t_meta")
_daily = "ts_code, canonical_ts_code, trade_date, close, pre_close, adj_factor, close_hfq, volume_share, amount_cny, daily_return, listing_age_trading_days, listing_age_status, has_listing_reference, is_within_listing_window, security_code_interval_valid, is_sh_sz"
plan("daily_panel", lambda p: p.daily.select(*_daily.split(", ")), f"SELECT {_daily} FROM t_daily", "close pre_close adj_factor close_hfq volume_share amount_cny daily_return", 6)
plan(
    "scd2_history",
    lambda p: p.names.select("ts_code", "canonical_ts_code", "stock_name", pn.is_st(F.col("stock_name")).alias("is_st_name_flag"), "effective_from", "effective_to"),
    "SELECT n.ts_code, coalesce(m.canonical_ts_code, n.ts_code) AS canonical_ts_code, stock_name, is_st_name_flag, effective_from, effective_to FROM t_name n LEFT JOIN t_identity m ON m.ts_code = n.ts_code",
)
plan(
    "interval_join",
    lambda p: pn.interval_join(pn.interval_join(p["b_month_end"].select("ts_code", "signal_date"), "signal_date", p.industry, ["industry_code"]), "signal_date", p.names, ["stock_name"]).withColumn("has_industry_history", F.col("industry_code").isNotNull()),
    "SELECT ts_code, signal_date, industry_code, stock_name, has_industry_history FROM (SELECT b.ts_code, b.signal_date, i.industry_code, n.stock_name, i.industry_code IS NOT NULL AS has_industry_history FROM b_month_end b LEFT JOIN t_industry i ON i.ts_code = b.ts_code AND i.effective_from <= b.signal_date AND (i.effective_to IS NULL OR b.signal_date <= i.effective_to) LEFT JOIN t_name n ON n.ts_code = b.ts_code AND n.effective_from <= b.signal_date AND (n.effective_to IS NULL OR b.signal_date <= n.effective_to))",
)
_susp = "ts_code, trade_date, has_suspend_s, has_resume_r, suspend_intervals, suspended_at_open"
plan("suspend_aggregate", lambda p: p.suspended, f"SELECT {_susp} FROM t_suspend")
_exec = "ts_code, canonical_ts_code, trade_date, open_price, has_daily_price, has_suspend_record, has_suspend_s, has_resume_r, suspend_intervals, suspended_at_open, up_limit, down_limit, open_at_up_limit, open_at_down_limit, security_code_interval_valid, invalid_security_code_interval, cannot_buy_at_open, cannot_sell_at_open, execution_block_reason"
plan("execution_status", lambda p: p.status.select(*_exec.split(", ")), f"SELECT {_exec} FROM t_exec", "open_price up_limit down_limit", 6)
_month = "ts_code, canonical_ts_code, signal_date, liquidity_20d, available_history_observations, has_enough_252d_history, industry_code, is_st_name_flag, total_mv_cny"
plan("month_end_panel", lambda p: p.monthly.select(*_month.split(", ")), f"SELECT {_month} FROM t_month", "liquidity_20d total_mv_cny", 3)
plan("benchmark_returns", lambda p: pn.benchmark_returns(p["b_benchmark"]), "SELECT benchmark_code, trade_date, close, close / lag(close) OVER (PARTITION BY benchmark_code ORDER BY trade_date) - 1 AS benchmark_return FROM b_benchmark", "close benchmark_return")
_bound = """SELECT h.old_ts_code, h.new_ts_code, h.canonical_ts_code, h.effective_date, o.trade_date AS old_last_trade_date, n.trade_date AS new_first_trade_date, o.close AS old_last_close, n.pre_close AS new_first_pre_close, n.close AS new_first_close,
  n.pre_close - o.close AS pre_close_minus_old_close, abs(n.adj_factor / o.adj_factor - 1) AS adj_factor_relative_difference, n.close * n.adj_factor / (o.close * o.adj_factor) - 1 AS adjusted_boundary_return,
  (SELECT min(trade_date) FROM t_daily d WHERE d.ts_code = h.old_ts_code) AS old_raw_first_date, (SELECT max(trade_date) FROM t_daily d WHERE d.ts_code = h.old_ts_code) AS old_raw_last_date,
  (SELECT min(trade_date) FROM t_daily d WHERE d.ts_code = h.new_ts_code) AS new_raw_first_date, (SELECT max(trade_date) FROM t_daily d WHERE d.ts_code = h.new_ts_code) AS new_raw_last_date,
  (SELECT count(*) FROM t_daily d WHERE d.ts_code = h.new_ts_code AND d.trade_date < h.effective_date) AS new_code_backfill_rows,
  (SELECT count(*) - count(DISTINCT trade_date) FROM t_daily d WHERE d.canonical_ts_code = h.canonical_ts_code) AS raw_canonical_duplicate_rows,
  (SELECT count(*) - count(DISTINCT trade_date) FROM t_daily d WHERE d.canonical_ts_code = h.canonical_ts_code AND d.security_code_interval_valid) AS valid_canonical_duplicate_rows
  FROM b_code_history h
  LEFT JOIN (SELECT d.*, row_number() OVER (PARTITION BY d.ts_code ORDER BY d.trade_date DESC) AS rn FROM t_daily d JOIN b_code_history x ON x.old_ts_code = d.ts_code WHERE d.trade_date < x.effective_date AND d.security_code_interval_valid) o ON o.ts_code = h.old_ts_code AND o.rn = 1
  LEFT JOIN (SELECT d.*, row_number() OVER (PARTITION BY d.ts_code ORDER BY d.trade_date) AS rn FROM t_daily d JOIN b_code_history x ON x.new_ts_code = d.ts_code WHERE d.trade_date >= x.effective_date AND d.security_code_interval_valid) n ON n.ts_code = h.new_ts_code AND n.rn = 1"""
plan("code_boundary", lambda p: pn.code_boundary(p["b_code_history"], p.daily), _bound, "old_last_close new_first_pre_close new_first_close pre_close_minus_old_close adj_factor_relative_difference adjusted_boundary_return")
_tests = {"OLD_LAST_TRADE_DATE": "old_last_trade_date < effective_date", "NEW_FIRST_TRADE_DATE": "new_first_trade_date = effective_date", "NEW_FIRST_PRE_CLOSE_VS_OLD_CLOSE": "abs(pre_close_minus_old_close) <= 0.005", "OLD_LAST_CLOSE": "old_last_close > 0", "ADJ_FACTOR_BOUNDARY": "adj_factor_relative_difference <= 0.001", "CANONICAL_DUPLICATE_DATES": "valid_canonical_duplicate_rows <= 0"}
_all = " AND ".join(f"coalesce({c}, false)" for c in _tests.values())
plan(
    "code_boundary_tests",
    lambda p: pn.code_boundary_tests(pn.code_boundary(p["b_code_history"], p.daily)),
    " UNION ALL ".join(f"SELECT old_ts_code, new_ts_code, canonical_ts_code, CASE WHEN {_all} THEN 'PASS' ELSE 'FAIL' END AS boundary_status, '{t}' AS test_name, CASE WHEN coalesce({c}, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_bound})" for t, c in _tests.items()),
)
_dates = ["1996-03-15", "1998-07-01", "1999-01-12", "2000-10-20"]
_days = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in _dates) + ") AS g(audit_date)"
_cats = {
    "NORMAL": ("has_daily_price AND NOT cannot_buy_at_open AND NOT cannot_sell_at_open", "0", "0"),
    "SUSPENDED_OR_NO_PRICE": ("NOT has_daily_price OR suspended_at_open", "suspended_at_open::INT", "has_suspend_record::INT"),
    "NAME_CHANGED_STOCK": ("has_daily_price AND nk > 1 AND stock_name IS NOT NULL", "nk", "0"),
    "INDUSTRY_CHANGED_STOCK": ("has_daily_price AND ik > 1 AND industry_code IS NOT NULL", "ik", "0"),
}
plan(
    "sample_join_audit",
    lambda p: pn.sample_join_audit(p.status, p.industry, p.names, _dates),
    f"""SELECT g.audit_date, c.sample_category, s.ts_code, coalesce(s.join_status, 'NO_ELIGIBLE_SAMPLE') AS join_status FROM {_days} CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in _cats)}) AS c(sample_category)
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, sample_category ORDER BY o1 DESC, o2 DESC, ts_code) AS rn FROM ("""
    + " UNION ALL ".join(f"SELECT trade_date, ts_code, '{c}' AS sample_category, {a} AS o1, {b} AS o2, CASE WHEN stock_name IS NOT NULL THEN 'NAME_JOINED' ELSE 'NAME_MISSING' END || '|' || CASE WHEN industry_code IS NOT NULL THEN 'INDUSTRY_JOINED' ELSE 'INDUSTRY_MISSING' END AS join_status FROM audit_base WHERE {w}" for c, (w, a, b) in _cats.items()).replace(
        "audit_base",
        f"""(SELECT e.*, n.stock_name, i.industry_code, (SELECT count(DISTINCT x.stock_name) FROM t_name x WHERE x.ts_code = e.ts_code AND x.effective_from <= e.trade_date) AS nk,
          (SELECT count(DISTINCT x.industry_code) FROM t_industry x WHERE x.ts_code = e.ts_code AND x.effective_from <= e.trade_date) AS ik
          FROM t_exec e LEFT JOIN t_name n ON n.ts_code = e.ts_code AND n.effective_from <= e.trade_date AND (n.effective_to IS NULL OR e.trade_date <= n.effective_to)
          LEFT JOIN t_industry i ON i.ts_code = e.ts_code AND i.effective_from <= e.trade_date AND (i.effective_to IS NULL OR e.trade_date <= i.effective_to) WHERE e.trade_date IN ({", ".join(f"DATE '{d}'" for d in _dates)}))""",
    )
    + ")) WHERE rn = 1) s ON s.trade_date = g.audit_date AND s.sample_category = c.sample_category",
)

# Factors
for _name, _col in (("value_factor", "bm_proxy"), ("momentum", "momentum_12_1"), ("low_volatility", "lowvol_60"), ("forward_label", "next_month_return")):
    plan(_name, lambda p, c=_col: p.raw.select(*fc.KEY, c), f"SELECT {KEY}, {_col} FROM t_raw", _col)
_uni = f"{KEY}, universe_pre_liquidity, liquidity_20pct_cutoff, universe_eligible"
plan("universe_filter", lambda p: fc.universe_filter(p.raw, keep=p._keep).select(*_uni.split(", ")), f"SELECT {_uni} FROM t_universe", "liquidity_20pct_cutoff", 2)
_win = [f"{f}_{x}" for f in FACTORS for x in ("p01", "p99", "winsorized")]
plan("winsorize", lambda p: fc.winsorize(fc.universe_filter(p.raw, keep=p._keep), keep=p._keep).select(*fc.KEY, *_win), f"SELECT {KEY}, {', '.join(_win)} FROM t_winsor", " ".join(_win))
_z = [f"{f}_{x}" for f in FACTORS for x in ("z_mean", "z_std", "z")]
plan("zscore", lambda p: p.factor_panel.select(*fc.KEY, *_z), f"SELECT {KEY}, {', '.join(_z)} FROM t_panel", " ".join(_z), 7)
_panel = ["next_month_return", *FACTORS, *(f"{f}_winsorized" for f in FACTORS), *(f"{f}_z" for f in FACTORS)]
plan("factor_panel", lambda p: p.factor_panel.select(*fc.KEY, "universe_eligible", *_panel), f"SELECT {KEY}, universe_eligible, {', '.join(_panel)} FROM t_panel", " ".join(_panel), 7)

# Diagnostics
plan(
    "factor_coverage",
    lambda p: dg.factor_coverage(p.factor_panel),
    """SELECT *, raw_factor_rows / base_rows AS raw_factor_coverage_rate, universe_eligible_rows / base_rows AS universe_eligible_rate, evaluation_rows / nullif(universe_eligible_rows, 0) AS evaluation_rate_of_eligible FROM (
    SELECT signal_date, factor, count(*) AS base_rows, count(raw) AS raw_factor_rows, count(*) FILTER (WHERE universe_pre_liquidity) AS universe_pre_liquidity_rows, count(*) FILTER (WHERE universe_eligible) AS universe_eligible_rows,
    count(*) FILTER (WHERE universe_eligible AND next_month_return IS NOT NULL AND z IS NOT NULL) AS evaluation_rows FROM t_long GROUP BY signal_date, factor)""",
    "raw_factor_coverage_rate universe_eligible_rate evaluation_rate_of_eligible",
)
plan("monthly_rank_ic", lambda p: p.ic, "SELECT signal_date, factor, rank_ic, observations FROM t_ic", "rank_ic")
_ic = "avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS rank_ic_std, CASE WHEN stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) * sqrt(12) END AS rank_icir_annualized, avg(CASE WHEN rank_ic IS NOT NULL THEN (round(rank_ic, 12) > 0)::INT END) AS positive_rank_ic_rate"
plan("ic_summary", lambda p: dg.ic_summary(p.ic), f"SELECT factor, count(rank_ic) AS months, {_ic}, min(rank_ic) AS minimum_rank_ic, max(rank_ic) AS maximum_rank_ic FROM t_ic GROUP BY factor", "mean_rank_ic rank_ic_std rank_icir_annualized positive_rank_ic_rate minimum_rank_ic maximum_rank_ic", 7)
plan("quintile_returns", lambda p: p.quintiles, "SELECT * FROM t_qr", "mean_next_month_return")
plan(
    "annual_results",
    lambda p: dg.annual_results(p.ic, p.quintiles),
    f"""SELECT factor, year, coalesce(rank_ic_months, 0) AS rank_ic_months, mean_rank_ic, rank_ic_std, rank_icir_annualized, positive_rank_ic_rate, coalesce(spread_months, 0) AS spread_months, mean_top_minus_bottom, compounded_top_minus_bottom, positive_top_minus_bottom_rate FROM
    (SELECT factor, year(signal_date)::INT AS year, count(rank_ic) AS rank_ic_months, {_ic} FROM t_ic GROUP BY ALL) FULL JOIN
    (SELECT factor, year(signal_date)::INT AS year, count(*) AS spread_months, avg(mean_next_month_return) AS mean_top_minus_bottom, product(1 + mean_next_month_return) - 1 AS compounded_top_minus_bottom, avg((mean_next_month_return > 0)::INT) AS positive_top_minus_bottom_rate
      FROM t_qr WHERE quintile = 'TOP_MINUS_BOTTOM' GROUP BY ALL) USING (factor, year)""",
    "mean_rank_ic rank_ic_std rank_icir_annualized positive_rank_ic_rate mean_top_minus_bottom compounded_top_minus_bottom positive_top_minus_bottom_rate",
    7,
)
_pairs = " UNION ALL ".join(f"SELECT signal_date, '{a}' AS factor_left, '{b}' AS factor_right, round({a}_z, 9) AS x, round({b}_z, 9) AS y FROM t_panel WHERE universe_eligible" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :])
_by = "signal_date, factor_left, factor_right"


def _ranked(x: str, by: str, only: str) -> str:
    return f"CASE WHEN {only} THEN rank() OVER (PARTITION BY {by}, {only} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {only}, {x}) - 1) / 2.0::DOUBLE END"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count({x}) >= 5 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


_fc = f"SELECT {_by}, {_corr('a', 'b')} AS spearman_correlation, count(a) AS observations FROM (SELECT {_by}, {_ranked('x', _by, '(x IS NOT NULL AND y IS NOT NULL)')} AS a, {_ranked('y', _by, '(x IS NOT NULL AND y IS NOT NULL)')} AS b FROM ({_pairs})) GROUP BY ALL"
plan("factor_correlation", lambda p: dg.factor_correlation(p.factor_panel), _fc, "spearman_correlation")
plan(
    "factor_correlation_summary",
    lambda p: dg.factor_correlation_summary(dg.factor_correlation(p.factor_panel)),
    f"SELECT factor_left, factor_right, count(spearman_correlation) AS months, avg(spearman_correlation) AS mean_spearman_correlation, stddev_samp(spearman_correlation) AS std_spearman_correlation, min(spearman_correlation) AS minimum_spearman_correlation, max(spearman_correlation) AS maximum_spearman_correlation FROM ({_fc}) GROUP BY ALL",
    "mean_spearman_correlation std_spearman_correlation minimum_spearman_correlation maximum_spearman_correlation",
    7,
)
plan(
    "industry_exposure",
    lambda p: dg.industry_exposure(p.factor_panel),
    """SELECT signal_date, factor, industry_code, universe_count, top_quintile_count, mean_factor_z, uw AS universe_weight, tw AS top_quintile_weight, tw - uw AS active_weight FROM (SELECT *, universe_count / sum(universe_count) OVER (PARTITION BY signal_date, factor) AS uw,
      top_quintile_count / nullif(sum(top_quintile_count) OVER (PARTITION BY signal_date, factor), 0) AS tw FROM (SELECT signal_date, factor, industry_code, count(*) AS universe_count, count(*) FILTER (WHERE least(greatest(ceil(r / n * 5), 1), 5) = 5) AS top_quintile_count, avg(z) AS mean_factor_z
      FROM (SELECT signal_date, factor, coalesce(industry_code, 'UNCLASSIFIED') AS industry_code, z, rank() OVER (PARTITION BY signal_date, factor ORDER BY z) + (count(*) OVER (PARTITION BY signal_date, factor, z) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY signal_date, factor) AS n
        FROM t_long WHERE universe_eligible AND z IS NOT NULL) WHERE n >= 5 GROUP BY ALL))""",
    "mean_factor_z universe_weight top_quintile_weight active_weight",
)
plan(
    "size_exposure",
    lambda p: dg.size_exposure(p.factor_panel),
    f"SELECT signal_date, factor, {_corr('zz', 'sz')} AS pearson_corr_log_total_mv, {_corr('a', 'b')} AS spearman_corr_log_total_mv, count(a) AS observations FROM (SELECT signal_date, factor, z AS zz, CASE WHEN z IS NOT NULL THEN s END AS sz, {_ranked('z', 'signal_date, factor', '(z IS NOT NULL)')} AS a, {_ranked('round(s, 9)', 'signal_date, factor', '(z IS NOT NULL)')} AS b FROM (SELECT *, ln(total_mv_cny) AS s FROM t_long WHERE universe_eligible AND total_mv_cny > 0)) GROUP BY ALL",
    "pearson_corr_log_total_mv spearman_corr_log_total_mv",
)
plan(
    "worst_periods",
    lambda p: dg.worst_periods(p.ic, p.quintiles),
    """SELECT factor, metric, signal_date, value, worst_rank FROM (SELECT *, row_number() OVER (PARTITION BY factor, metric ORDER BY round(value, 9), signal_date)::INT AS worst_rank FROM (SELECT factor, 'RANK_IC' AS metric, signal_date, rank_ic AS value FROM t_ic
      UNION ALL SELECT factor, 'TOP_MINUS_BOTTOM', signal_date, mean_next_month_return FROM t_qr WHERE quintile = 'TOP_MINUS_BOTTOM') WHERE value IS NOT NULL) WHERE worst_rank <= 5""",
    "value",
)
from factorloom.plans import accounts, audits, intake  # noqa: E402, F401  (they register the rest)
