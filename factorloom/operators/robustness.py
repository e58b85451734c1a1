"""Variants of the factor panel and sensitivities of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.ordering import with_quantiles
from factorloom.functions.stats import per_group
from factorloom.operators.factors import FACTORS, zscore
from factorloom.operators.portfolio import composite_topn

Z = [f"{f}_z" for f in FACTORS]


def microcap_filter(panel: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Eligible rows without the month's smallest by market value."""
    rows = panel.where("universe_eligible")
    rows = with_quantiles(rows, ["signal_date"], {"microcap": F.col("total_mv_cny")}, {"cutoff": quantile})
    return rows.where(F.round("total_mv_cny", 4) >= F.round("microcap_cutoff", 4))


def _restandardized(rows: DataFrame) -> DataFrame:
    return zscore(rows.drop(*Z, *(f"{z}_{m}" for z in Z for m in ("mean", "std"))), {f"__{z}": z for z in Z}).drop(*(f"__{z}" for z in Z))


def industry_neutral(panel: DataFrame) -> DataFrame:
    """Scores less their industry's mean of the month, standardised again."""
    group = Window.partitionBy("signal_date", F.coalesce("industry_code", F.lit("UNKNOWN")))
    rows = panel.where("universe_eligible")
    return _restandardized(rows.withColumns({f"__{z}": F.col(z) - F.avg(z).over(group) for z in Z}))


def size_neutral(panel: DataFrame) -> DataFrame:
    """Residuals of scores on the logarithm of market value in each month, standardised again;
    null for months of fewer than three rows or of one size."""
    rows = panel.where("universe_eligible").withColumn("__size", F.when(F.col("total_mv_cny") > 0, F.ln("total_mv_cny")))
    lines = []
    for z in Z:
        x = F.when(F.col(z).isNotNull(), F.col("__size"))
        fits = (F.count(F.when(x.isNotNull(), F.col(z))) >= 3) & (F.stddev_samp(x) > 0)
        lines += [F.when(fits, F.regr_slope(F.col(z), F.col("__size"))).alias(f"__{z}_b"), F.when(fits, F.regr_intercept(F.col(z), F.col("__size"))).alias(f"__{z}_a")]
    rows = per_group(rows, ["signal_date"], lines)
    rows = rows.withColumns({f"__{z}": F.col(z) - (F.col(f"__{z}_a") + F.col(f"__{z}_b") * F.col("__size")) for z in Z})
    return _restandardized(rows).drop("__size", *(f"__{z}_{x}" for z in Z for x in "ab"))


def variant_signals(variants: dict[str, DataFrame], k: int) -> DataFrame:
    """The selections of several variants of the panel, with experiment_id."""
    frames = [composite_topn(rows.na.drop(subset=Z), k).withColumn("experiment_id", F.lit(name)) for name, rows in variants.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def variant_diagnostics(sources: dict[str, DataFrame], variants: dict[str, DataFrame], selected: DataFrame) -> DataFrame:
    """For each variant: eligible rows of its source and of the variant, months, and how many are
    selected in a month."""
    counts = []
    for name, rows in variants.items():
        before = sources[name].where("universe_eligible").agg(F.count(F.lit(1)).alias("eligible_rows_before"))
        usable = rows.where("universe_eligible").na.drop(subset=Z).agg(F.count(F.lit(1)).alias("eligible_rows_after"), F.count_distinct("signal_date").alias("signal_months"))
        counts.append(before.join(usable).withColumn("experiment_id", F.lit(name)))  # one row each
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    months = selected.groupBy("experiment_id", "signal_date").agg(F.count(F.lit(1)).alias("n"))
    per = months.groupBy("experiment_id").agg(F.min("n").alias("minimum_selected"), F.max("n").alias("maximum_selected"), F.avg("n").alias("average_selected"))
    return out.withColumn("removed_rows", F.col("eligible_rows_before") - F.col("eligible_rows_after")).join(per, "experiment_id", "left")


def experiment_catalogue(registry: DataFrame, recovery: DataFrame, failures: DataFrame, costs: list[str], baseline: str) -> DataFrame:
    """Every experiment with its category, source and main results: paths and cost rates of the
    registry, the case of no recovery at the end for the baseline scenario, and the analysis
    of failed orders, which has counts only. Returns are logarithms."""
    kind = F.when(F.col("experiment_id").isin(costs), "COST").when(F.col("experiment_id") == "BASELINE", "REFERENCE").otherwise("VARIANT")
    shape = ["experiment_id", "category", "source", "log_total_return", "annualized_log_return", "maximum_drawdown", "failed_orders"]
    none = lambda kind: F.lit(None).cast(kind)
    paths = registry.select("experiment_id", kind.alias("category"), F.lit("DRIFTING_PATH").alias("source"), "log_total_return", "annualized_log_return", "maximum_drawdown", none("long").alias("failed_orders"))
    log = lambda c: F.when(F.col(c) > -1, F.log1p(c))
    worst = recovery.where(F.col("cost_scenario") == baseline).where("recovery_rate = 0.0")
    worst = worst.select(F.lit("DELIST_TERMINAL_RECOVERY").alias("experiment_id"), F.lit("TERMINAL").alias("category"), F.lit("TERMINAL_SENSITIVITY").alias("source"), log("adjusted_total_return").alias("log_total_return"), log("adjusted_annualized_return").alias("annualized_log_return"), none("double").alias("maximum_drawdown"), none("long").alias("failed_orders"))
    failed = failures.agg(F.sum("orders").alias("failed_orders")).select(F.lit("FAILURE_PERIOD_ANALYSIS").alias("experiment_id"), F.lit("DIAGNOSTIC").alias("category"), F.lit("FAILED_ORDERS").alias("source"), *(none("double").alias(c) for c in shape[3:6]), "failed_orders")
    return paths.unionByName(worst).unionByName(failed).withColumn("status", F.when((F.col("source") == "DRIFTING_PATH") & F.col("log_total_return").isNull(), "MISSING").otherwise("PASS"))


def at_other_costs(selected: DataFrame, of: str, names: list[str]) -> DataFrame:
    """Selections with those of one experiment once more under each of the names."""
    again = F.explode(F.array(*map(F.lit, names))).alias("experiment_id")
    same = [c for c in selected.columns if c != "experiment_id"]
    return selected.unionByName(selected.where(F.col("experiment_id") == of).select(*same, again))


def experiment_registry(selected: DataFrame, nav: DataFrame, cost: Column) -> DataFrame:
    """One row for each experiment: rows, months, how many are selected in a month, and what its
    path in ``nav`` (``drift_nav`` by experiment_id) returned, fell, traded and paid. Drawdowns are
    between rebalances, from a NAV of 1 on; the total return is a logarithm."""
    months = selected.groupBy("experiment_id", "signal_date").agg(F.count(F.lit(1)).alias("n"))
    counts = months.groupBy("experiment_id").agg(F.sum("n").alias("selected_rows"), F.count(F.lit(1)).alias("signal_months"), F.min("n").alias("minimum_selected"), F.max("n").alias("maximum_selected"), F.avg("n").alias("average_selected"))
    so_far = Window.partitionBy("experiment_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    path = nav.withColumn("fall", F.col("nav_at_end") / F.greatest(F.lit(1.0), F.max("nav_at_end").over(so_far)) - 1)
    results = path.groupBy("experiment_id").agg(
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.ln(F.max_by("nav_at_end", "trade_date")).alias("log_total_return"),
        F.least(F.min("fall"), F.lit(0.0)).alias("maximum_drawdown"),
        F.sum("turnover").alias("two_way_turnover"),
        F.sum(cost * F.col("turnover")).alias("trading_cost_share"),
    )
    years = F.date_diff("end_date", "start_date") / 365.25
    results = results.withColumn("annualized_log_return", F.when(F.col("end_date") > F.col("start_date"), F.col("log_total_return") / years))
    return counts.join(results, "experiment_id", "left")


def recovery_sensitivity(performance: DataFrame, stale: DataFrame, rates: list[float]) -> DataFrame:
    """Results if the stale value at the end recovered only in part. ``stale`` has carrying_value
    and stale_weight by scenario."""
    rows = performance.join(stale, "cost_scenario").select("*", F.explode(F.array(*map(F.lit, rates))).alias("recovery_rate"))
    terminal = F.col("carrying_value") / F.col("stale_weight")
    total = (terminal - F.col("carrying_value") * (1 - F.col("recovery_rate"))) / (terminal / (1 + F.col("strategy_total_return"))) - 1
    rows = rows.withColumn("adjusted_total_return", total)
    annual = F.pow(1 + F.col("adjusted_total_return"), 252 / F.col("trading_days")) - 1
    return rows.select(
        "cost_scenario",
        "recovery_rate",
        terminal.alias("original_terminal_nav"),
        "adjusted_total_return",
        annual.alias("adjusted_annualized_return"),
        (F.col("adjusted_total_return") - F.col("strategy_total_return")).alias("total_return_change"),
        (annual - F.col("strategy_annualized_return")).alias("annualized_return_change"),
    )
