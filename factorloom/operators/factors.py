"""Monthly factors of a universe: value, momentum, low volatility; label, universe, winsor, z.

Windows over time go by canonical code. Cross-sections are aggregates of a month joined back:
moments directly, quantiles by counts of values in buckets, so no task holds or sorts a month.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.ordering import with_quantiles
from factorloom.functions.stats import per_group

FACTORS = ["bm_proxy", "momentum_12_1", "lowvol_60"]
KEY = ["canonical_ts_code", "signal_date"]
#: Bars that factors are made of.
VALID_BAR = "is_sh_sz and is_within_listing_window and security_code_interval_valid and close_hfq > 0"

Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class FactorRules:
    recent_skip: int = 21
    lookback: int = 252
    volatility_window: int = 60
    liquidity_window: int = 20
    minimum_age: int = 120
    liquidity_quantile: float = 0.2
    winsor: tuple[float, float] = (0.01, 0.99)
    exclude_st: bool = True


def daily_features(panel: DataFrame, rules: FactorRules = FactorRules()) -> DataFrame:
    """Of each entity's valid bars: past prices, rolling volatility and liquidity. All windows
    share one sort."""
    day = Window.partitionBy("canonical_ts_code").orderBy("trade_date")
    rows = panel.where(VALID_BAR).select("ts_code", "canonical_ts_code", "trade_date", F.col("close_hfq").alias("adjusted_price"), "amount_cny")
    rows = rows.withColumn("canonical_daily_return", F.col("adjusted_price") / F.lag("adjusted_price").over(day) - 1)
    volatile, liquid = day.rowsBetween(1 - rules.volatility_window, 0), day.rowsBetween(1 - rules.liquidity_window, 0)
    return rows.select(
        "*",
        F.lag("adjusted_price", rules.recent_skip).over(day).alias("price_recent"),
        F.lag("adjusted_price", rules.lookback).over(day).alias("price_past"),
        F.count("canonical_daily_return").over(volatile).alias("volatility_observations"),
        F.stddev_samp("canonical_daily_return").over(volatile).alias("volatility"),
        F.count("amount_cny").over(liquid).alias("liquidity_observations"),
        F.avg("amount_cny").over(liquid).alias("canonical_liquidity_20d"),
    )


def value_factor() -> Column:
    return F.when(F.col("pb") > 0, 1 / F.col("pb"))


def momentum() -> Column:
    return F.when((F.col("price_recent") > 0) & (F.col("price_past") > 0), F.col("price_recent") / F.col("price_past") - 1)


def low_volatility(rules: FactorRules) -> Column:
    return F.when(F.col("volatility_observations") == rules.volatility_window, -F.col("volatility"))


def raw_factors(monthly: DataFrame, features: DataFrame, rules: FactorRules = FactorRules()) -> DataFrame:
    """Month-end rows with factors, and the return to the next month-end if it is the next
    calendar month."""
    bars = features.drop("amount_cny").withColumnRenamed("trade_date", "asof_trade_date")
    rows = monthly.where("is_sh_sz and is_within_listing_window and security_code_interval_valid").join(bars, ["ts_code", "canonical_ts_code", "asof_trade_date"])
    ahead = Window.partitionBy("canonical_ts_code").orderBy("signal_date")
    month = lambda c: F.year(c) * 12 + F.month(c)
    following, price = F.lead("signal_date").over(ahead), F.lead("adjusted_price").over(ahead)
    return rows.select(
        "*",
        F.when((month(following) - month(F.col("signal_date")) == 1) & (price > 0), price / F.col("adjusted_price") - 1).alias("next_month_return"),
        value_factor().alias("bm_proxy"),
        momentum().alias("momentum_12_1"),
        low_volatility(rules).alias("lowvol_60"),
    )


def _as_is(figures: DataFrame, name: str) -> DataFrame:
    return figures


def universe_filter(raw: DataFrame, rules: FactorRules = FactorRules(), keep: Keep = _as_is) -> DataFrame:
    """Who may be ranked: listed long enough, priced, liquid in the last days, all factors known,
    and not among the month's least liquid."""
    fits = (
        F.col("has_listing_reference")
        & (F.col("listing_age_trading_days") >= rules.minimum_age)
        & (F.col("adjusted_price") > 0)
        & (F.col("pb") > 0)
        & F.col("bm_proxy").isNotNull()
        & F.col("momentum_12_1").isNotNull()
        & F.col("lowvol_60").isNotNull()
        & (F.col("liquidity_observations") == rules.liquidity_window)
        & F.col("canonical_liquidity_20d").isNotNull()
    )
    if rules.exclude_st:
        fits = fits & ~F.coalesce("is_st_name_flag", F.lit(False))
    rows = raw.withColumn("universe_pre_liquidity", F.coalesce(fits, F.lit(False)))
    liquidity = F.when(F.col("universe_pre_liquidity"), F.col("canonical_liquidity_20d"))
    rows = with_quantiles(rows, ["signal_date"], {"liquidity": liquidity}, {"20pct_cutoff": rules.liquidity_quantile}, lambda x: keep(x, "cutoffs"))
    # Both sides rounded: a computed quantile never decides by its last bit.
    liquid = F.round("canonical_liquidity_20d", 2) >= F.round("liquidity_20pct_cutoff", 2)
    return rows.withColumn("universe_eligible", F.coalesce(F.col("universe_pre_liquidity") & liquid, F.lit(False)))


def winsorize(rows: DataFrame, factors: list[str] = FACTORS, limits: tuple[float, float] = (0.01, 0.99), keep: Keep = _as_is) -> DataFrame:
    """Eligible rows' factors clamped to their month's quantiles."""
    eligible = F.col("universe_eligible")
    rows = with_quantiles(rows, ["signal_date"], {f: F.when(eligible, F.col(f)) for f in factors}, dict(zip(("p01", "p99"), limits, strict=True)), lambda x: keep(x, "limits"))
    return rows.withColumns({f"{f}_winsorized": F.when(eligible, F.greatest(F.col(f"{f}_p01"), F.least(F.col(f"{f}_p99"), F.col(f)))) for f in factors})


def zscore(rows: DataFrame, columns: dict[str, str], keep: Keep = _as_is) -> DataFrame:
    """Standard scores within the month of value column -> score column; null where the month's
    deviation is not positive."""
    aggregates = [g(v).alias(f"{z}_{n}") for v, z in columns.items() for g, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    rows = per_group(rows, ["signal_date"], aggregates, lambda x: keep(x, "moments"))
    return rows.withColumns({z: F.when(F.col(f"{z}_std") > 0, (F.col(v) - F.col(f"{z}_mean")) / F.col(f"{z}_std")) for v, z in columns.items()})


def factor_panel(monthly: DataFrame, panel: DataFrame, rules: FactorRules = FactorRules()) -> DataFrame:
    """Raw, winsorized and standardised factors with label, universe and moments."""
    return scored(raw_factors(monthly, daily_features(panel, rules), rules), rules)


def scored(raw: DataFrame, rules: FactorRules = FactorRules(), keep: Keep = _as_is) -> DataFrame:
    """Raw factors with universe, winsorized and standardised scores. Each step reads the raw rows for
    a month's figures; ``keep`` may write these few rows and read them back, so that no step shuffles
    or stores the panel's own."""
    clamped = winsorize(universe_filter(raw, rules, keep), FACTORS, rules.winsor, keep)
    return zscore(clamped, {f"{f}_winsorized": f"{f}_z" for f in FACTORS}, keep)
