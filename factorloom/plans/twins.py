"""SQL twins: the panels that oracle queries read, as DuckDB text over the bindings.

``{...}`` names in PANELS refer to other panels; ``twin(sql)`` puts those that a query names
into its WITH clause."""

from __future__ import annotations

import re

from factorloom.sources.bindings import BINDINGS, used

FACTORS = ("bm_proxy", "momentum_12_1", "lowvol_60")
_USABLE = "is_within_listing_window AND security_code_interval_valid"

PANELS = {
    "t_calendar": "SELECT cal_date, row_number() OVER (ORDER BY cal_date) AS open_day_number FROM b_trade_cal WHERE is_open = 1",
    "t_identity": """SELECT old_ts_code AS ts_code, canonical_ts_code, effective_date, original_list_date, 'OLD_CODE' AS security_code_role FROM b_code_history
        UNION ALL SELECT new_ts_code, canonical_ts_code, effective_date, original_list_date, 'NEW_CODE' FROM b_code_history""",
    "t_meta": """SELECT u.ts_code, coalesce(m.canonical_ts_code, u.ts_code) AS canonical_ts_code, coalesce(m.original_list_date, s.list_date) AS list_date,
          s.delist_date, m.security_code_role, m.effective_date, m.ts_code IS NOT NULL AS has_manual_code_history,
          coalesce(m.original_list_date, s.list_date) IS NOT NULL AS has_listing_reference,
          coalesce(coalesce(m.original_list_date, s.list_date) < DATE '1995-01-01', false) AS listing_age_is_lower_bound,
          (SELECT min(open_day_number) FROM t_calendar c WHERE c.cal_date >= greatest(coalesce(m.original_list_date, s.list_date), DATE '1995-01-01')
             AND coalesce(m.original_list_date, s.list_date) IS NOT NULL) AS listing_start_open_day
        FROM (SELECT ts_code FROM b_stock_basic UNION SELECT ts_code FROM t_identity) u
        LEFT JOIN b_stock_basic s ON s.ts_code = u.ts_code LEFT JOIN t_identity m ON m.ts_code = u.ts_code""",
    "t_daily0": """SELECT d.*, a.adj_factor, coalesce(s.canonical_ts_code, d.ts_code) AS canonical_ts_code, s.list_date, s.delist_date, s.security_code_role, s.effective_date,
          d.close * a.adj_factor AS close_hfq, d.open * a.adj_factor AS open_hfq, d.vol * 100 AS volume_share, d.amount * 1000 AS amount_cny,
          split_part(d.ts_code, '.', 2) IN ('SH', 'SZ') AS is_sh_sz, coalesce(s.has_listing_reference, false) AS has_listing_reference,
          CASE WHEN coalesce(s.has_listing_reference, false) THEN d.trade_date >= s.list_date AND (s.delist_date IS NULL OR d.trade_date <= s.delist_date) ELSE false END AS is_within_listing_window,
          CASE WHEN s.security_code_role = 'OLD_CODE' THEN d.trade_date < s.effective_date WHEN s.security_code_role = 'NEW_CODE' THEN d.trade_date >= s.effective_date ELSE true END AS security_code_interval_valid,
          coalesce(s.has_manual_code_history, false) AS has_manual_code_history, coalesce(s.listing_age_is_lower_bound, false) AS listing_age_is_lower_bound,
          c.open_day_number, s.listing_start_open_day
        FROM b_daily d LEFT JOIN b_adj a ON a.ts_code = d.ts_code AND a.trade_date = d.trade_date
        LEFT JOIN t_meta s ON s.ts_code = d.ts_code LEFT JOIN t_calendar c ON c.cal_date = d.trade_date""",
    "t_daily": """SELECT *, lag(close) OVER w AS pre_close,
          CASE WHEN security_code_interval_valid AND coalesce(lag(security_code_interval_valid) OVER w, false) THEN close_hfq / lag(close_hfq) OVER w - 1 END AS daily_return,
          CASE WHEN is_within_listing_window THEN open_day_number - listing_start_open_day + 1 END AS listing_age_trading_days,
          CASE WHEN NOT has_listing_reference THEN 'MISSING_LISTING_REFERENCE' WHEN NOT is_within_listing_window THEN 'OUTSIDE_CONFIRMED_LISTING_WINDOW'
               WHEN has_manual_code_history AND listing_age_is_lower_bound THEN 'MANUAL_ORIGINAL_LIST_DATE_LOWER_BOUND' WHEN has_manual_code_history THEN 'MANUAL_ORIGINAL_LIST_DATE_EXACT'
               WHEN listing_age_is_lower_bound THEN 'LOWER_BOUND_CALENDAR_START' ELSE 'EXACT_WITHIN_AVAILABLE_CALENDAR' END AS listing_age_status
        FROM t_daily0 WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)""",
    "t_suspend": """SELECT ts_code, trade_date, bool_or(kind = 'S') AS has_suspend_s, bool_or(kind = 'R') AS has_resume_r, string_agg(DISTINCT event, '|' ORDER BY event) AS suspend_intervals,
          bool_or(kind = 'S' AND (segment = '' OR (length(segment) = 11 AND split_part(segment, '-', 1) <= '09:30' AND split_part(segment, '-', 2) >= '09:30'))) AS suspended_at_open
        FROM (SELECT *, trim(unnest(string_split(timing, ','))) AS segment FROM (
          SELECT ts_code, trade_date, upper(trim(suspend_type)) AS kind, trim(coalesce(suspend_timing, '')) AS timing,
            upper(trim(suspend_type)) || ':' || CASE WHEN trim(coalesce(suspend_timing, '')) <> '' THEN trim(suspend_timing) WHEN upper(trim(suspend_type)) = 'S' THEN 'FULL_DAY' ELSE 'UNSPECIFIED' END AS event
          FROM b_suspend)) GROUP BY ts_code, trade_date""",
    "t_exec0": """SELECT k.ts_code, k.trade_date, coalesce(d.canonical_ts_code, m.canonical_ts_code, k.ts_code) AS canonical_ts_code, d.open AS open_price,
          d.open IS NOT NULL AND d.close IS NOT NULL AS has_daily_price, s.ts_code IS NOT NULL AS has_suspend_record, coalesce(s.has_suspend_s, false) AS has_suspend_s,
          coalesce(s.has_resume_r, false) AS has_resume_r, s.suspend_intervals, coalesce(s.suspended_at_open, false) AS suspended_at_open, l.up_limit, l.down_limit,
          coalesce(d.open IS NOT NULL AND d.close IS NOT NULL AND (round(d.open, 2) >= round(l.up_limit, 2) OR abs(d.open - l.up_limit) <= 0.005), false) AS open_at_up_limit,
          coalesce(d.open IS NOT NULL AND d.close IS NOT NULL AND (round(d.open, 2) <= round(l.down_limit, 2) OR abs(d.open - l.down_limit) <= 0.005), false) AS open_at_down_limit,
          CASE WHEN m.security_code_role = 'OLD_CODE' THEN k.trade_date < m.effective_date WHEN m.security_code_role = 'NEW_CODE' THEN k.trade_date >= m.effective_date ELSE true END AS security_code_interval_valid
        FROM (SELECT ts_code, trade_date FROM t_daily UNION SELECT ts_code, trade_date FROM b_limit UNION SELECT ts_code, trade_date FROM t_suspend) k
        LEFT JOIN t_daily d ON d.ts_code = k.ts_code AND d.trade_date = k.trade_date LEFT JOIN b_limit l ON l.ts_code = k.ts_code AND l.trade_date = k.trade_date
        LEFT JOIN t_suspend s ON s.ts_code = k.ts_code AND s.trade_date = k.trade_date LEFT JOIN t_identity m ON m.ts_code = k.ts_code""",
    "t_exec": """SELECT *, NOT security_code_interval_valid AS invalid_security_code_interval, NOT has_daily_price OR suspended_at_open OR open_at_up_limit AS cannot_buy_at_open,
          NOT has_daily_price OR suspended_at_open OR open_at_down_limit AS cannot_sell_at_open,
          nullif(concat_ws('|', CASE WHEN NOT has_daily_price THEN 'NO_DAILY_PRICE' END, CASE WHEN suspended_at_open THEN 'SUSPENDED_AT_OPEN' END,
            CASE WHEN open_at_up_limit THEN 'OPEN_AT_UP_LIMIT' END, CASE WHEN open_at_down_limit THEN 'OPEN_AT_DOWN_LIMIT' END), '') AS execution_block_reason FROM t_exec0""",
    "t_industry": "SELECT DISTINCT ts_code, industry_code, effective_from, effective_to FROM b_industry_history",
    "t_name": "SELECT DISTINCT ts_code, stock_name, contains(upper(stock_name), 'ST') AS is_st_name_flag, effective_from, effective_to FROM b_name_history",
    "t_month": f"""SELECT b.*, x.canonical_ts_code, x.listing_age_trading_days, x.listing_age_status, x.has_listing_reference, x.is_within_listing_window, x.security_code_interval_valid, x.is_sh_sz,
          x.available_history_observations, CASE WHEN x.n = 20 THEN x.m END AS liquidity_20d, x.available_history_observations >= 252 AS has_enough_252d_history,
          i.industry_code, n.stock_name, n.is_st_name_flag, b.total_mv * 10000 AS total_mv_cny, i.industry_code IS NOT NULL AS has_industry_history
        FROM b_month_end b JOIN (SELECT *, count(CASE WHEN {_USABLE} THEN 1 END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS available_history_observations,
            count(CASE WHEN {_USABLE} THEN amount_cny END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING) AS n,
            avg(CASE WHEN {_USABLE} THEN amount_cny END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING) AS m FROM t_daily) x
          ON x.ts_code = b.ts_code AND x.trade_date = b.asof_trade_date
        LEFT JOIN t_industry i ON i.ts_code = b.ts_code AND i.effective_from <= b.signal_date AND (i.effective_to IS NULL OR b.signal_date <= i.effective_to)
        LEFT JOIN t_name n ON n.ts_code = b.ts_code AND n.effective_from <= b.signal_date AND (n.effective_to IS NULL OR b.signal_date <= n.effective_to)""",
    "t_returns": f"SELECT ts_code, canonical_ts_code, trade_date, close_hfq AS adjusted_price, amount_cny, close_hfq / lag(close_hfq) OVER (PARTITION BY canonical_ts_code ORDER BY trade_date) - 1 AS r FROM t_daily WHERE is_sh_sz AND {_USABLE} AND close_hfq > 0",
}


def feature_panels(skip: int = 21, lookback: int = 252, window: int = 60, suffix: str = "", until: str | None = None) -> dict[str, str]:
    """The panels from daily features to standard scores for given windows; with ``until`` from
    bars and month-ends up to that day only."""
    s = suffix
    bars = f"(SELECT * FROM t_returns WHERE trade_date <= DATE '{until}')" if until else "t_returns"
    months = f"(SELECT * FROM t_month WHERE signal_date <= DATE '{until}')" if until else "t_month"
    limits = ", ".join(f"quantile_cont({f}, {q}) FILTER (WHERE universe_eligible) OVER (PARTITION BY signal_date) AS {f}_{n}" for f in FACTORS for q, n in ((0.01, "p01"), (0.99, "p99")))
    clamped = ", ".join(f"CASE WHEN universe_eligible THEN greatest({f}_p01, least({f}_p99, {f})) END AS {f}_winsorized" for f in FACTORS)
    moments = ", ".join(f"avg({f}_winsorized) OVER (PARTITION BY signal_date) AS {f}_z_mean, stddev_samp({f}_winsorized) OVER (PARTITION BY signal_date) AS {f}_z_std" for f in FACTORS)
    scores = ", ".join(f"CASE WHEN {f}_z_std > 0 THEN ({f}_winsorized - {f}_z_mean) / {f}_z_std END AS {f}_z" for f in FACTORS)
    return {
        f"t_features{s}": f"""SELECT *, lag(adjusted_price, {skip}) OVER w AS price_recent, lag(adjusted_price, {lookback}) OVER w AS price_past,
            count(r) OVER (PARTITION BY canonical_ts_code ORDER BY trade_date ROWS {window - 1} PRECEDING) AS volatility_observations,
            stddev_samp(r) OVER (PARTITION BY canonical_ts_code ORDER BY trade_date ROWS {window - 1} PRECEDING) AS volatility,
            count(amount_cny) OVER (PARTITION BY canonical_ts_code ORDER BY trade_date ROWS 19 PRECEDING) AS liquidity_observations,
            avg(amount_cny) OVER (PARTITION BY canonical_ts_code ORDER BY trade_date ROWS 19 PRECEDING) AS canonical_liquidity_20d
            FROM {bars} WINDOW w AS (PARTITION BY canonical_ts_code ORDER BY trade_date)""",
        f"t_raw{s}": f"""SELECT *, CASE WHEN (year(nd) * 12 + month(nd)) - (year(signal_date) * 12 + month(signal_date)) = 1 AND np > 0 THEN np / adjusted_price - 1 END AS next_month_return,
            CASE WHEN pb > 0 THEN 1 / pb END AS bm_proxy, CASE WHEN price_recent > 0 AND price_past > 0 THEN price_recent / price_past - 1 END AS momentum_12_1,
            CASE WHEN volatility_observations = {window} THEN -volatility END AS lowvol_60
            FROM (SELECT m.*, d.adjusted_price, d.price_recent, d.price_past, d.volatility_observations, d.volatility, d.liquidity_observations, d.canonical_liquidity_20d,
              lead(m.signal_date) OVER (PARTITION BY m.canonical_ts_code ORDER BY m.signal_date) AS nd, lead(d.adjusted_price) OVER (PARTITION BY m.canonical_ts_code ORDER BY m.signal_date) AS np
              FROM {months} m JOIN t_features{s} d ON d.ts_code = m.ts_code AND d.canonical_ts_code = m.canonical_ts_code AND d.trade_date = m.asof_trade_date WHERE m.is_sh_sz AND m.is_within_listing_window AND m.security_code_interval_valid)""",
        f"t_universe{s}": f"""SELECT *, coalesce(universe_pre_liquidity AND round(canonical_liquidity_20d, 2) >= round(liquidity_20pct_cutoff, 2), false) AS universe_eligible
            FROM (SELECT *, quantile_cont(canonical_liquidity_20d, 0.2) FILTER (WHERE universe_pre_liquidity) OVER (PARTITION BY signal_date) AS liquidity_20pct_cutoff
              FROM (SELECT *, coalesce(has_listing_reference AND listing_age_trading_days >= 120 AND adjusted_price > 0 AND pb > 0 AND bm_proxy IS NOT NULL AND momentum_12_1 IS NOT NULL AND lowvol_60 IS NOT NULL
                AND liquidity_observations = 20 AND canonical_liquidity_20d IS NOT NULL AND NOT coalesce(is_st_name_flag, false), false) AS universe_pre_liquidity FROM t_raw{s}))""",
        f"t_winsor{s}": f"SELECT *, {clamped} FROM (SELECT *, {limits} FROM t_universe{s})",
        f"t_panel{s}": f"SELECT *, {scores} FROM (SELECT *, {moments} FROM t_winsor{s})",
    }


PANELS |= feature_panels()
PANELS |= feature_panels(lookback=189, suffix="_m")
PANELS |= feature_panels(window=120, suffix="_v")
#: Day up to which the older run of a reconciliation knows its inputs.
CUT = "1999-12-31"
PANELS |= feature_panels(suffix="_c", until=CUT)
PANELS |= {
    "t_long": " UNION ALL ".join(f"SELECT *, '{f}' AS factor, {f} AS raw, round({f}_z, 9) AS z FROM t_panel" for f in FACTORS),
    "t_eval": "SELECT *, round(next_month_return, 9) AS label FROM t_long WHERE universe_eligible AND next_month_return IS NOT NULL",
    "t_ic": """SELECT signal_date, factor, CASE WHEN count(a) >= 5 AND min(a) < max(a) AND min(b) < max(b) THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS rank_ic, count(a) AS observations
        FROM (SELECT signal_date, factor, CASE WHEN z IS NOT NULL THEN rank() OVER (PARTITION BY signal_date, factor ORDER BY z) + (count(*) OVER (PARTITION BY signal_date, factor, z) - 1) / 2.0::DOUBLE END AS a,
          CASE WHEN z IS NOT NULL THEN rank() OVER (PARTITION BY signal_date, factor, z IS NOT NULL ORDER BY label) + (count(*) OVER (PARTITION BY signal_date, factor, z IS NOT NULL, label) - 1) / 2.0::DOUBLE END AS b
          FROM t_eval) GROUP BY signal_date, factor""",
    "t_quint": """SELECT *, least(greatest(ceil(r / n * 5), 1), 5)::INT AS q FROM (SELECT *, rank() OVER (PARTITION BY signal_date, factor ORDER BY z) + (count(*) OVER (PARTITION BY signal_date, factor, z) - 1) / 2.0::DOUBLE AS r,
          count(*) OVER (PARTITION BY signal_date, factor) AS n FROM t_eval WHERE z IS NOT NULL) WHERE n >= 5""",
    "t_qr": """SELECT signal_date, factor, 'Q' || q AS quintile, avg(next_month_return) AS mean_next_month_return, count(*) AS observations FROM t_quint GROUP BY ALL
        UNION ALL SELECT signal_date, factor, 'TOP_MINUS_BOTTOM', avg(next_month_return) FILTER (WHERE q = 5) - avg(next_month_return) FILTER (WHERE q = 1), least(count(*) FILTER (WHERE q = 5), count(*) FILTER (WHERE q = 1))
          FROM t_quint GROUP BY signal_date, factor HAVING count(*) FILTER (WHERE q = 5) > 0 AND count(*) FILTER (WHERE q = 1) > 0""",
}


def _names(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", sql)))
    return [n for n in PANELS if n in words]


def twin(sql: str) -> str:
    """A query over panels and bindings with all it names in its WITH clause, in order."""
    needed, todo = set(), _names(sql)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += _names(PANELS[n])
    texts = [sql, *(PANELS[n] for n in needed)]
    base, todo = set(), [b for t in texts for b in used(t) if b in BINDINGS]
    while todo:
        b = todo.pop()
        if b not in base:
            base.add(b)
            todo += [c for c in used(BINDINGS[b]) if c in BINDINGS]
    parts = [f"{b} AS ({BINDINGS[b].strip()})" for b in BINDINGS if b in base] + [f"{n} AS ({PANELS[n]})" for n in PANELS if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + f"SELECT * FROM ({sql}) AS q"

