"""Single-factor diagnostics of a factor panel, in long form (month, factor, ...)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.ordering import with_average_ranks
from factorloom.functions.stats import bucket, safe_corr
from factorloom.operators.factors import FACTORS, KEY

MINIMUM, QUINTILES, ANNUAL = 5, 5, math.sqrt(12)


def long_form(panel: DataFrame, keep: list[str], factors: list[str] = FACTORS) -> DataFrame:
    """A row for each factor: factor, raw, z (rounded to nine digits, so that ranks do not depend
    on last bits), and the kept columns."""
    options = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("raw"), F.round(f"{f}_z", 9).alias("z")) for f in factors))
    return panel.select(*keep, F.explode(options).alias("f")).select(*keep, "f.*")


def factor_coverage(panel: DataFrame) -> DataFrame:
    rows = long_form(panel, ["signal_date", "universe_pre_liquidity", "universe_eligible", "next_month_return"])
    usable = F.col("universe_eligible") & F.col("next_month_return").isNotNull() & F.col("z").isNotNull()
    counts = rows.groupBy("signal_date", "factor").agg(
        F.count(F.lit(1)).alias("base_rows"),
        F.count("raw").alias("raw_factor_rows"),
        F.count_if("universe_pre_liquidity").alias("universe_pre_liquidity_rows"),
        F.count_if("universe_eligible").alias("universe_eligible_rows"),
        F.count_if(usable).alias("evaluation_rows"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return counts.select(
        "*",
        share("raw_factor_rows", "base_rows").alias("raw_factor_coverage_rate"),
        share("universe_eligible_rows", "base_rows").alias("universe_eligible_rate"),
        share("evaluation_rows", "universe_eligible_rows").alias("evaluation_rate_of_eligible"),
    )


def evaluated(panel: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Long rows that are eligible and labelled."""
    return long_form(panel.where("universe_eligible and next_month_return is not null"), [*KEY, "next_month_return", *(keep or [])])


def monthly_rank_ic(panel: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Spearman correlation of factor and next month's return."""
    by, both = ["signal_date", "factor"], F.col("z").isNotNull()
    rows = evaluated(panel).withColumn("label", F.round("next_month_return", 9))
    rows = with_average_ranks(rows, by, {"a": F.col("z"), "b": F.when(both, F.col("label"))})
    return rows.groupBy(*by).agg(safe_corr(F.col("a"), F.col("b"), minimum).alias("rank_ic"), F.count("a").alias("observations"))


def _ic_aggregates(x: str) -> list[Column]:
    sure = F.col(x).isNotNull()
    return [
        F.count(x).alias("months"),
        F.avg(x).alias("mean_rank_ic"),
        F.stddev_samp(x).alias("rank_ic_std"),
        F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * ANNUAL).alias("rank_icir_annualized"),
        # Rounded: the last bit of a correlation of zero does not make it positive.
        F.avg(F.when(sure, (F.round(x, 12) > 0).cast("double"))).alias("positive_rank_ic_rate"),
    ]


def ic_summary(monthly_ic: DataFrame) -> DataFrame:
    return monthly_ic.groupBy("factor").agg(*_ic_aggregates("rank_ic"), F.min("rank_ic").alias("minimum_rank_ic"), F.max("rank_ic").alias("maximum_rank_ic"))


def quintiled(rows: DataFrame, keep: list[str], minimum: int = MINIMUM) -> DataFrame:
    """Long rows with a score, with their quintile; months of too few rows are left out."""
    by = ["signal_date", "factor"]
    ranked = with_average_ranks(rows.where("z is not null").select(*by, *keep, "z"), by, {"r": F.col("z")}, total="n")
    return ranked.where(F.col("n") >= max(minimum, QUINTILES)).select(*by, *keep, "z", bucket(F.col("r"), F.col("n"), QUINTILES).alias("quintile"))


def quintile_returns(panel: DataFrame) -> DataFrame:
    """Mean next return of each quintile, and of the top less the bottom one."""
    rows = quintiled(evaluated(panel), ["next_month_return"])
    means = rows.groupBy("signal_date", "factor", "quintile").agg(F.avg("next_month_return").alias("mean_next_month_return"), F.count(F.lit(1)).alias("observations"))
    at = lambda q, c: F.max(F.when(F.col("quintile") == q, F.col(c)))
    spread = means.groupBy("signal_date", "factor").agg(
        (at(QUINTILES, "mean_next_month_return") - at(1, "mean_next_month_return")).alias("mean_next_month_return"),
        F.when(at(QUINTILES, "observations").isNotNull() & at(1, "observations").isNotNull(), F.least(at(QUINTILES, "observations"), at(1, "observations"))).alias("observations"),
    )
    spread = spread.where("observations is not null").withColumn("quintile", F.lit("TOP_MINUS_BOTTOM"))
    return means.withColumn("quintile", F.concat(F.lit("Q"), F.col("quintile"))).unionByName(spread)


def annual_results(monthly_ic: DataFrame, quintiles: DataFrame) -> DataFrame:
    """IC and spread statistics by factor and year."""
    by = ["factor", F.year("signal_date").alias("year")]
    ic = monthly_ic.groupBy(*by).agg(*_ic_aggregates("rank_ic")).withColumnRenamed("months", "rank_ic_months")
    x = F.col("mean_next_month_return")
    spread = (
        quintiles.where("quintile = 'TOP_MINUS_BOTTOM'")
        .groupBy(*by)
        .agg(F.count(x).alias("spread_months"), F.avg(x).alias("mean_top_minus_bottom"), (F.product(1 + x) - 1).alias("compounded_top_minus_bottom"), F.avg((x > 0).cast("double")).alias("positive_top_minus_bottom_rate"))
    )
    return ic.join(spread, ["factor", "year"], "full").na.fill(0, ["rank_ic_months", "spread_months"])


def factor_correlation(panel: DataFrame, factors: list[str] = FACTORS, minimum: int = MINIMUM) -> DataFrame:
    """Spearman correlation of each pair of factors in each month's universe."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    options = F.array(*(F.struct(F.lit(a).alias("factor_left"), F.lit(b).alias("factor_right"), F.round(f"{a}_z", 9).alias("x"), F.round(f"{b}_z", 9).alias("y")) for a, b in pairs))
    by = ["signal_date", "factor_left", "factor_right"]
    rows = panel.where("universe_eligible").select("signal_date", F.explode(options).alias("p")).select("signal_date", "p.*")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    ranked = with_average_ranks(rows, by, {"a": F.when(both, F.col("x")), "b": F.when(both, F.col("y"))})
    return ranked.groupBy(*by).agg(safe_corr(F.col("a"), F.col("b"), minimum).alias("spearman_correlation"), F.count("a").alias("observations"))


def factor_correlation_summary(monthly: DataFrame) -> DataFrame:
    x = F.col("spearman_correlation")
    return monthly.groupBy("factor_left", "factor_right").agg(
        F.count(x).alias("months"), F.avg(x).alias("mean_spearman_correlation"), F.stddev_samp(x).alias("std_spearman_correlation"), F.min(x).alias("minimum_spearman_correlation"), F.max(x).alias("maximum_spearman_correlation")
    )


def industry_exposure(panel: DataFrame) -> DataFrame:
    """Share of each industry in the universe and in the top quintile."""
    rows = long_form(panel.where("universe_eligible"), [*KEY, "industry_code"]).withColumn("industry_code", F.coalesce("industry_code", F.lit("UNCLASSIFIED")))
    counts = (
        quintiled(rows, ["industry_code"], minimum=QUINTILES)
        .groupBy("signal_date", "factor", "industry_code")
        .agg(F.count(F.lit(1)).alias("universe_count"), F.count_if(F.col("quintile") == QUINTILES).alias("top_quintile_count"), F.avg("z").alias("mean_factor_z"))
    )
    month = Window.partitionBy("signal_date", "factor")
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(month).cast("double"))
    return counts.withColumns({"universe_weight": share("universe_count"), "top_quintile_weight": share("top_quintile_count")}).withColumn("active_weight", F.col("top_quintile_weight") - F.col("universe_weight"))


def size_exposure(panel: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Pearson and Spearman correlation of factors with the logarithm of market value."""
    by, both = ["signal_date", "factor"], F.col("z").isNotNull()
    rows = long_form(panel.where("universe_eligible and total_mv_cny > 0").withColumn("size", F.ln("total_mv_cny")), ["signal_date", "size"]).drop("raw").withColumn("size_rank", F.round("size", 9))
    rows = with_average_ranks(rows, by, {"a": F.col("z"), "b": F.when(both, F.col("size_rank"))})
    return rows.groupBy(*by).agg(
        safe_corr(F.col("z"), F.col("size"), minimum).alias("pearson_corr_log_total_mv"), safe_corr(F.col("a"), F.col("b"), minimum).alias("spearman_corr_log_total_mv"), F.count("a").alias("observations")
    )


def worst_periods(monthly_ic: DataFrame, quintiles: DataFrame, count: int = 5) -> DataFrame:
    """The worst months of each factor by IC and by spread; ties go to the earlier month."""
    ic = monthly_ic.select("factor", F.lit("RANK_IC").alias("metric"), "signal_date", F.col("rank_ic").alias("value"))
    spread = quintiles.where("quintile = 'TOP_MINUS_BOTTOM'").select("factor", F.lit("TOP_MINUS_BOTTOM").alias("metric"), "signal_date", F.col("mean_next_month_return").alias("value"))
    order = Window.partitionBy("factor", "metric").orderBy(F.round("value", 9), "signal_date")
    return ic.union(spread).where("value is not null").withColumn("worst_rank", F.row_number().over(order)).where(F.col("worst_rank") <= count)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
