"""Data-quality checks and reconciliation; each check is one aggregate over its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import portfolio
from factorloom.operators.intervals import overlapping_pairs


def checks(df: DataFrame, category: str, violations: dict[str, Column]) -> DataFrame:
    """Rows check_id, category, observed (rows that violate), expected, status. All checks of a
    table share one pass."""
    one = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(violations.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check_id"), F.col(f"c{i}").alias("observed")) for i, k in enumerate(violations))))
    return _verdict(one.select(rows.alias("r")).select("r.*"), category)


def _verdict(rows: DataFrame, category: str) -> DataFrame:
    return rows.select("check_id", F.lit(category).alias("category"), "observed", F.lit(0).cast("long").alias("expected"), F.when(F.col("observed") == 0, "PASS").otherwise("FAIL").alias("status"))


def all_checks(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Keys that occur more than once, for each table."""
    return all_checks([checks(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "KEY_UNIQUENESS", {name: F.col("n") > 1}) for name, (df, key) in tables.items()])


def missing_keys(left: DataFrame, right: DataFrame, key: list[str], name: str) -> DataFrame:
    """Keys of left that right has not."""
    absent = left.select(*key).distinct().join(right.select(*key).distinct(), key, "left_anti")
    return _verdict(absent.agg(F.count(F.lit(1)).alias("observed")).withColumn("check_id", F.lit(name)), "KEY_COVERAGE")


def key_symmetric_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys in only one of both tables, with the side that has them."""
    sides = left.select(*key).distinct().withColumn("side", F.lit("LEFT_ONLY")).unionByName(right.select(*key).distinct().withColumn("side", F.lit("RIGHT_ONLY")))
    return sides.groupBy(*key).agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def interval_overlap(history: DataFrame, name: str) -> DataFrame:
    """Pairs of intervals of one code that share a day, and intervals that end before they begin."""
    pairs = overlapping_pairs(history, ["ts_code"]).agg(F.coalesce(F.sum("overlapping_pairs"), F.lit(0)).alias("observed"))
    reversed_ = checks(history, "INTERVALS", {f"{name}_reversed": F.col("effective_to") < F.col("effective_from")})
    return _verdict(pairs.withColumn("check_id", F.lit(f"{name}_overlaps")), "INTERVALS").unionByName(reversed_)


def cell_grid(rows: DataFrame, row: str, column: str, values: list[str], expected: DataFrame | None = None) -> DataFrame:
    """How many rows each cell of a grid has: a line for each value of ``row`` (and of expected,
    where given), a column for each declared value, and the declared values whose cell is empty.
    The pivot's values are declared, so it takes one pass and its shape does not depend on the data."""
    grid = rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    if expected is not None:
        grid = expected.select(row).distinct().join(grid, row, "full")
    grid = grid.na.fill(0, values)
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(f"`{v}`") == 0, F.lit(v)) for v in values)), lambda x: x.isNotNull()), ",")
    return grid.withColumn("missing", missing)


def panel_profile(panel: DataFrame) -> DataFrame:
    """Counts and ranges of the daily panel in one pass."""
    return panel.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("ts_code").alias("codes"),
        F.count_distinct("ts_code", "trade_date").alias("distinct_keys"),
        F.min("trade_date").alias("minimum_date"),
        F.max("trade_date").alias("maximum_date"),
        F.count_if(F.col("canonical_ts_code").isNull()).alias("missing_canonical"),
        F.count_if(~F.col("is_within_listing_window")).alias("outside_listing_rows"),
        F.count_if(~F.col("security_code_interval_valid")).alias("invalid_interval_rows"),
        F.min(F.when(F.col("is_sh_sz"), F.col("trade_date"))).alias("minimum_sh_sz_date"),
    )


def prefix_reconcile(old: DataFrame, new: DataFrame, key: list[str], categories: list[str], numbers: list[str], tolerance: float) -> DataFrame:
    """Whether a longer run repeats an earlier one on the keys of the earlier one's span."""
    left = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in categories + numbers), F.lit(1).alias("in_old"))
    right = new.select(*key, *(F.col(c).alias(f"n_{c}") for c in categories + numbers), F.lit(1).alias("in_new"))
    return _reconciled(left.join(right, key, "full"), categories, numbers, tolerance)


def _reconciled(both: DataFrame, categories: list[str], numbers: list[str], tolerance: float) -> DataFrame:
    """The verdict on rows with o_<name>, n_<name>, in_old and in_new (null: absent)."""
    present = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    differs = reduce(lambda a, b: a | b, (~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in categories)) if categories else F.lit(False)
    error = F.greatest(*(F.when(F.col(f"o_{c}").isNull() != F.col(f"n_{c}").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.abs(F.col(f"o_{c}") - F.col(f"n_{c}")), F.lit(0.0))) for c in numbers), F.lit(0.0))
    a = both.agg(
        F.count("in_old").alias("old_rows"),
        F.count("in_new").alias("new_rows"),
        F.count_if(~present).alias("missing_or_extra_rows"),
        F.count_if(present & differs).alias("categorical_mismatches"),
        F.coalesce(F.max(F.when(present, error)), F.lit(0.0)).alias("maximum_numeric_error"),
    )
    fine = (F.col("missing_or_extra_rows") == 0) & (F.col("categorical_mismatches") == 0) & (F.col("maximum_numeric_error") <= tolerance)
    return a.withColumn("status", F.when(fine, "PASS").otherwise("FAIL"))


def reconciled_holdings(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], days: DataFrame, key: list[str], code: str, tolerance: float) -> DataFrame:
    """``prefix_reconcile`` of the ``stale_valuation`` of both runs on the given days, each run by its
    ledger and prices. Ledgers and prices are put side by side and days made from both at once, so the
    rows by day, which are far more, need no join."""
    def beside(i: int, on: list[str], columns: list[str]) -> DataFrame:
        sides = [df.select(*on, *(F.col(c).alias(f"{x}_{c}") for c in columns), F.lit(True).alias(f"__{x}")) for x, df in (("o", old[i]), ("n", new[i]))]
        return sides[0].join(sides[1], on, "full")

    def lasting(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
        """Each side's last row so far, where only the other side has one."""
        past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"{x}_{c}": F.last(F.when(F.col(f"__{x}"), F.struct(f"{x}_{c}")), ignorenulls=True).over(past)[f"{x}_{c}"] for x in ("o", "n") for c in columns}).drop("__o", "__n")

    ledger = lasting(beside(0, [*key, "trade_date"], ["units_after"]), key, ["units_after"], ["trade_date"])
    ledger = ledger.withColumn("units_after", F.greatest("o_units_after", "n_units_after"))
    of_price = ["price", "price_date", "price_kind"]
    old, new = ((held, prices.where("price is not null")) for held, prices in (old, new))
    both = lasting(beside(1, [code, "trade_date", "order"], of_price), [code], of_price, ["trade_date", "order"])
    rows = portfolio.priced_days(ledger, both, days, key, code, ["o_units_after", "n_units_after"], [f"{x}_{c}" for x in ("o", "n") for c in of_price])
    for x, name in (("o", "old"), ("n", "new")):
        held = F.col(f"{x}_units_after") > portfolio.EPSILON
        day = F.col("trade_date")
        made = {"units": F.col(f"{x}_units_after"), "market_value": F.col(f"{x}_units_after") * F.col(f"{x}_price"), "price_source": portfolio.price_source(F.col(f"{x}_price_kind"), F.col(f"{x}_price_date"), day), "stale_calendar_days": F.date_diff(day, F.col(f"{x}_price_date"))}
        rows = rows.withColumns({f"{x}_{c}": v for c, v in made.items()} | {f"in_{name}": F.when(held, 1)})
    return _reconciled(rows, ["price_source", "stale_calendar_days"], ["units", "price", "market_value"], tolerance)


def apart(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two values differ by more than the tolerance, or only one is known."""
    return F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())


def differs(a: str, b: str, tolerance: float) -> str:
    """``apart`` as an expression for both engines."""
    return f"coalesce(abs({a} - {b}) > {tolerance!r}, ({a} IS NULL) <> ({b} IS NULL))"


def rederived_factors(factors: DataFrame, panel: DataFrame, skip: int = 21, lookback: int = 252, window: int = 60) -> DataFrame:
    """Factor rows with momentum, volatility and label once more, by numbered bars instead of
    windows over neighbours: prices by their numbers, the deviation of returns from running sums,
    the label from the row of the following month."""
    by, code = Window.partitionBy("canonical_ts_code").orderBy("trade_date"), "canonical_ts_code"
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    bars = panel.where("is_sh_sz and is_within_listing_window and security_code_interval_valid and close_hfq > 0")
    bars = bars.select(code, "trade_date", F.col("close_hfq").alias("p"), F.row_number().over(by).alias("k"), (F.col("close_hfq") / F.lag("close_hfq").over(by) - 1).alias("r"))
    bars = bars.withColumns({"s1": F.coalesce(F.sum("r").over(so_far), F.lit(0.0)), "s2": F.coalesce(F.sum(F.col("r") * F.col("r")).over(so_far), F.lit(0.0))})
    at = lambda name, back, *columns: bars.select(code, (F.col("k") + back).alias("k"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    rows = factors.join(bars.select(code, F.col("trade_date").alias("asof_trade_date"), "k", "s1", "s2"), [code, "asof_trade_date"])
    rows = rows.join(at("recent", skip, "p"), [code, "k"], "left").join(at("past", lookback, "p"), [code, "k"], "left").join(at("before", window, "s1", "s2"), [code, "k"], "left")
    month = F.year("signal_date") * 12 + F.month("signal_date")
    later = factors.select(code, (month - 1).alias("month"), F.col("adjusted_price").alias("later_price"))
    rows = rows.withColumn("month", month).join(later, [code, "month"], "left")
    s1, s2 = F.col("s1") - F.col("before_s1"), F.col("s2") - F.col("before_s2")
    return rows.withColumns(
        {
            "want_momentum": F.col("recent_p") / F.col("past_p") - 1,
            "want_variance": F.greatest(s2 - s1 * s1 / window, F.lit(0.0)) / (window - 1),
            "want_label": F.col("later_price") / F.col("adjusted_price") - 1,
        }
    )


def mean_rank(value: str, by: list[str]) -> Column:
    """The mean rank once more, from the shares of rows below and up to a value."""
    order, n = Window.partitionBy(*by).orderBy(value), F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.round((F.percent_rank().over(order) * (n - 1) + 1 + F.cume_dist().over(order) * n), 0) / 2
