"""Performance of daily returns by scenario, period, year and month.

Two conventions of the reference are kept apart: the full run leaves out the first day's
return and counts years as (n - 1) / 252; periods and years use all their days, n / 252, and
their path starts at the first day's 1 + r."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252
_PERIOD = "period string, start date, end date"


def _annual(total: Column, years: Column) -> Column:
    return F.pow(1 + total, 1 / years) - 1


def _ratio(mean: Column, std: Column) -> Column:
    return F.when(std > 0, mean / std * math.sqrt(DAYS))


def performance_summary(nav: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of a whole run, from ``nav_daily``; a run for each value of the columns ``by``."""
    by = by or ["cost_scenario"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("trade_date")) == 1
    rows = nav.withColumns({"r": F.when(~first, F.col("strategy_daily_return")), "b": F.when(~first, F.col("benchmark_daily_return"))}).withColumn("x", F.col("r") - F.col("b"))
    last = lambda c: F.max_by(c, "trade_date")
    a = rows.groupBy(*by).agg(
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.count(F.lit(1)).alias("trading_days"),
        (last("strategy_nav") - 1).alias("strategy_total_return"),
        (last("benchmark_nav") - 1).alias("benchmark_total_return"),
        (F.stddev_samp("r") * math.sqrt(DAYS)).alias("strategy_annualized_volatility"),
        (F.stddev_samp("b") * math.sqrt(DAYS)).alias("benchmark_annualized_volatility"),
        _ratio(F.avg("r"), F.stddev_samp("r")).alias("strategy_sharpe_zero_rf"),
        F.min("strategy_drawdown").alias("strategy_max_drawdown"),
        F.min("benchmark_drawdown").alias("benchmark_max_drawdown"),
        last("relative_nav").alias("terminal_relative_nav"),
        (F.stddev_samp("x") * math.sqrt(DAYS)).alias("tracking_error_annualized"),
        _ratio(F.avg("x"), F.stddev_samp("x")).alias("information_ratio"),
    )
    years = F.greatest((F.col("trading_days") - 1) / DAYS, F.lit(1 / DAYS))
    a = a.withColumns({f"{n}_annualized_return": _annual(F.col(f"{n}_total_return"), years) for n in ("strategy", "benchmark")})
    return a.withColumn("annualized_return_difference", F.col("strategy_annualized_return") - F.col("benchmark_annualized_return"))


ACCOUNT = ["portfolio_id", "cost_scenario"]


def account_performance(accounts: DataFrame) -> DataFrame:
    """``performance_summary`` of each account of ``account_daily``, with its cash and stale
    weights, turnover, cost sums and counts of failed and partial orders. The highest cash weight
    is over the days from the first fill on: before it all is cash."""
    so_far = Window.partitionBy(*ACCOUNT).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    accounts = accounts.withColumn("__begun", F.sum("turnover_notional").over(so_far) > 0)
    last = lambda c: F.max_by(c, "trade_date")
    extra = accounts.groupBy(*ACCOUNT).agg(
        F.avg("cash_weight").alias("average_cash_weight"),
        F.max(F.when(F.col("__begun"), F.col("cash_weight"))).alias("maximum_cash_weight"),
        F.max("stale_weight").alias("maximum_stale_weight"),
        last("stale_weight").alias("terminal_stale_weight"),
        (last("stale_market_value") / last("initial_capital")).alias("terminal_stale_share_of_capital"),
        F.max("maximum_stale_calendar_days").alias("maximum_stale_calendar_days"),
        F.sum("turnover_ratio").alias("cumulative_two_way_turnover"),
        *((F.sum(c) / last("initial_capital")).alias(f"total_{c.removeprefix('total_')}_share") for c in ("commission_cost", "stamp_duty_cost", "total_trading_cost")),
        *(F.sum(c).alias(c) for c in ("failed_buy_orders", "failed_sell_orders", "partial_order_count")),
    )
    years = F.greatest((F.col("trading_days") - 1) / DAYS, F.lit(1 / DAYS))
    rows = performance_summary(accounts.drop("__begun"), ACCOUNT).join(extra, ACCOUNT)
    return rows.withColumn("annualized_two_way_turnover", F.col("cumulative_two_way_turnover") / years)


def account_monthly(accounts: DataFrame) -> DataFrame:
    """Each account's months: compounded returns, turnover, cost, worst stale and mean cash weight."""
    compounded = lambda c: F.product(1 + F.col(c)) - 1
    months = accounts.groupBy(*ACCOUNT, F.date_format("trade_date", "yyyy-MM").alias("month")).agg(
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.count(F.lit(1)).alias("trading_days"),
        compounded("strategy_daily_return").alias("strategy_return"),
        compounded("benchmark_daily_return").alias("benchmark_return"),
        F.sum("turnover_ratio").alias("turnover"),
        (F.sum("total_trading_cost") / F.first("initial_capital")).alias("trading_cost_share"),
        F.max("stale_weight").alias("maximum_stale_weight"),
        F.avg("cash_weight").alias("average_cash_weight"),
        F.sum(F.col("failed_buy_orders") + F.col("failed_sell_orders")).alias("failed_orders"),
    )
    return months.withColumn("excess_return", F.col("strategy_return") - F.col("benchmark_return"))


def grouped_performance(returns: DataFrame, by: list[str]) -> DataFrame:
    """Of groups of whole days: totals, annualised figures, and drawdown within the group."""
    so_far = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumnsRenamed({"strategy_daily_return": "strategy", "benchmark_daily_return": "benchmark"})
    rows = rows.withColumns({f"{n}_path": F.product(1 + F.col(n)).over(so_far) for n in ("strategy", "benchmark")})
    rows = rows.withColumns({f"{n}_fall": F.col(f"{n}_path") / F.max(f"{n}_path").over(so_far) - 1 for n in ("strategy", "benchmark")}).withColumn("x", F.col("strategy") - F.col("benchmark"))
    a = rows.groupBy(*by).agg(
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.count(F.lit(1)).alias("trading_days"),
        *((F.max_by(f"{n}_path", "trade_date") - 1).alias(f"{n}_total_return") for n in ("strategy", "benchmark")),
        *((F.stddev_samp(n) * math.sqrt(DAYS)).alias(f"{n}_annualized_volatility") for n in ("strategy", "benchmark")),
        *(F.min(f"{n}_fall").alias(f"{n}_max_drawdown") for n in ("strategy", "benchmark")),
        _ratio(F.avg("strategy"), F.stddev_samp("strategy")).alias("strategy_sharpe_zero_rf"),
        (F.stddev_samp("x") * math.sqrt(DAYS)).alias("tracking_error_annualized"),
        _ratio(F.avg("x"), F.stddev_samp("x")).alias("information_ratio"),
    )
    years = F.col("trading_days") / DAYS
    a = a.withColumns({f"{n}_annualized_return": _annual(F.col(f"{n}_total_return"), years) for n in ("strategy", "benchmark")})
    return a.withColumn("terminal_relative_nav", (1 + F.col("strategy_total_return")) / (1 + F.col("benchmark_total_return")))


def with_periods(rows: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Each row under every period that holds its day."""
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in periods)))
    return rows.select("*", table.alias("p")).where(F.col("trade_date").between(F.col("p.a"), F.col("p.b"))).select(*rows.columns, "p.period")


def account_periods(accounts: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """``grouped_performance`` of each account and period, with its cash and stale weights, ages,
    turnover, costs and failed orders within the period."""
    rows, key = with_periods(accounts, periods), [*ACCOUNT, "period"]
    extra = rows.groupBy(*key).agg(
        F.avg("cash_weight").alias("average_cash_weight"),
        F.max("cash_weight").alias("maximum_cash_weight"),
        F.min("cash_weight").alias("minimum_cash_weight"),
        F.avg("stale_weight").alias("average_stale_weight"),
        F.max("stale_weight").alias("maximum_stale_weight"),
        F.max_by("stale_weight", "trade_date").alias("terminal_stale_weight"),
        F.max("maximum_stale_calendar_days").alias("maximum_stale_calendar_days"),
        F.count_if(F.col("stale_position_count") > 0).alias("stale_days"),
        F.sum("turnover_ratio").alias("two_way_turnover"),
        (F.sum("total_trading_cost") / F.max("initial_capital")).alias("trading_cost_share"),
        *(F.sum(c).alias(c) for c in ("failed_buy_orders", "failed_sell_orders", "partial_order_count")),
    )
    return grouped_performance(rows, key).join(extra, key)


def period_performance(returns: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    return grouped_performance(with_periods(returns, periods), ["cost_scenario", "period"])


def annual_performance(returns: DataFrame) -> DataFrame:
    return grouped_performance(returns.withColumn("year", F.year("trade_date")), ["cost_scenario", "year"])


def scenario_compare(periods: DataFrame, before: str, after: str) -> DataFrame:
    """Two periods side by side with their differences."""
    metrics = ["strategy_annualized_return", "strategy_annualized_volatility", "strategy_sharpe_zero_rf", "strategy_max_drawdown"]
    pick = lambda p, m: F.max(F.when(F.col("period") == p, F.col(m)))
    wide = periods.groupBy("cost_scenario").agg(*(x for m in metrics for x in (pick(before, m).alias(f"{m}_before"), pick(after, m).alias(f"{m}_after"))))
    return wide.withColumns({f"{m}_difference": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics})


def before_after_impact(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form: each metric of each scenario before and after a change."""
    both = before.alias("o").join(after.alias("n"), "cost_scenario")
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"o.{m}").alias("before"), F.col(f"n.{m}").alias("after")) for m in metrics)))
    return both.select("cost_scenario", rows.alias("r")).select("cost_scenario", "r.*").withColumn("difference", F.col("after") - F.col("before"))


def monthly_diagnostics(returns: DataFrame, orders: DataFrame) -> DataFrame:
    """Compounded returns of each month, with the failed orders in it."""
    month = F.date_format("trade_date", "yyyy-MM").alias("month")
    compounded = lambda c: F.product(1 + F.col(c)) - 1
    a = returns.groupBy("cost_scenario", month).agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("trading_days"), compounded("strategy_daily_return").alias("strategy_return"), compounded("benchmark_daily_return").alias("benchmark_return")
    )
    failed = orders.where("order_status = 'FAILED'").groupBy(month).agg(F.count(F.lit(1)).alias("failed_orders"))
    return a.join(failed, "month", "left").na.fill(0, ["failed_orders"]).withColumn("excess_return", F.col("strategy_return") - F.col("benchmark_return"))


def worst_months(monthly: DataFrame, count: int = 10) -> DataFrame:
    """The worst months by strategy and by excess return; ties go to the earlier month."""
    kinds = F.explode(F.array(F.struct(F.lit("WORST_STRATEGY_RETURN").alias("ranking_type"), F.col("strategy_return").alias("value")), F.struct(F.lit("WORST_EXCESS_RETURN").alias("ranking_type"), F.col("excess_return").alias("value"))))
    rows = monthly.select("cost_scenario", "month", kinds.alias("k")).select("cost_scenario", "month", "k.*")
    order = Window.partitionBy("cost_scenario", "ranking_type").orderBy(F.round("value", 10), "month")
    return rows.withColumn("worst_rank", F.row_number().over(order)).where(F.col("worst_rank") <= count)


def drawdown_episode(returns: DataFrame) -> DataFrame:
    """Peak, trough and recovery of each scenario's deepest fall."""
    by = ["cost_scenario"]
    so_far = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("nav", F.product(1 + F.col("strategy_daily_return")).over(so_far))
    rows = rows.withColumn("peak", F.max("nav").over(so_far)).withColumn("fall", F.round(F.col("nav") / F.col("peak") - 1, 12))
    trough = rows.groupBy(*by).agg(F.min_by(F.struct("trade_date", "fall", "peak"), F.struct("fall", "trade_date")).alias("t"))
    joined = rows.join(trough, by)
    at, level = F.col("t.trade_date"), F.round("t.peak", 12)
    return joined.groupBy(*by, "t").agg(
        F.min(F.when((F.col("trade_date") <= at) & (F.round("nav", 12) >= level), F.col("trade_date"))).alias("peak_date"),
        F.min(F.when((F.col("trade_date") >= at) & (F.round("nav", 12) >= level), F.col("trade_date"))).alias("recovery_date"),
    ).select(
        *by,
        "peak_date",
        at.alias("trough_date"),
        "recovery_date",
        F.col("t.fall").alias("maximum_drawdown"),
        F.date_diff(at, F.col("peak_date")).alias("calendar_days_peak_to_trough"),
        F.date_diff(F.col("recovery_date"), F.col("peak_date")).alias("calendar_days_to_recovery"),
        F.col("recovery_date").isNotNull().alias("recovered_by_end"),
    )


def chart_series(nav: DataFrame, annual: DataFrame) -> DataFrame:
    """What charts draw, in long form: series, scenario, position, value."""
    point = lambda s, x, v: F.struct(F.lit(s).alias("series"), F.col(x).cast("string").alias("position"), F.col(v).alias("value"))
    daily = nav.select("cost_scenario", F.explode(F.array(*(point(v, "trade_date", v) for v in ("strategy_nav", "benchmark_nav", "strategy_drawdown", "relative_nav")))).alias("p"))
    yearly = annual.select("cost_scenario", F.explode(F.array(*(point(v, "year", v) for v in ("strategy_total_return", "benchmark_total_return")))).alias("p"))
    return daily.union(yearly).select("cost_scenario", "p.*")


def chart_tables(ic: DataFrame, periods: list[tuple[str, str, str]], registry: DataFrame, recovery: DataFrame, baseline: str) -> DataFrame:
    """Points of three charts (chart, series, label, value, position from 1): mean rank IC by sample
    and factor, experiments by their annualised return from the lowest on, and the baseline's
    annualised return by recovery rate."""
    samples = with_periods(ic.withColumn("trade_date", F.col("signal_date")), periods).groupBy("period", "factor").agg(F.avg("rank_ic").alias("value"))
    names = F.array(*(F.lit(n) for n, _, _ in periods))
    by_sample = samples.select(F.lit("IC_BY_SAMPLE").alias("chart"), F.col("period").alias("series"), F.col("factor").alias("label"), "value", F.array_position(names, F.col("period")).cast("long").alias("position"))
    # One row for each experiment, and one for each rate.
    order = Window.orderBy(F.round("annualized_log_return", 9).asc_nulls_last(), "experiment_id")
    ranked = registry.select(F.lit("EXPERIMENTS").alias("chart"), F.when(F.col("annualized_log_return") >= 0, "GAIN").otherwise("LOSS").alias("series"), F.col("experiment_id").alias("label"), F.col("annualized_log_return").alias("value"), F.row_number().over(order).cast("long").alias("position"))
    curve = recovery.where(F.col("cost_scenario") == baseline).select(F.lit("RECOVERY").alias("chart"), F.col("cost_scenario").alias("series"), F.format_number("recovery_rate", 2).alias("label"), F.col("adjusted_annualized_return").alias("value"), F.row_number().over(Window.orderBy("recovery_rate")).cast("long").alias("position"))
    return by_sample.unionByName(ranked).unionByName(curve)
