"""Ranks, correlations and cross-sectional moments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def average_rank(value: Column, by: Names, only: Column) -> Column:
    """Average rank (ties share their mean rank) of value among the rows of a group with ``only``."""
    masked = F.when(only, value)
    order = Window.partitionBy(*by).orderBy(masked.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, masked))
    return F.when(only & value.isNotNull(), F.rank().over(order) + (ties - 1) / F.lit(2.0))


def safe_corr(x: Column, y: Column, minimum: int) -> Column:
    """Correlation over rows where both are known; null below ``minimum`` such rows or when one
    side is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    defined = (F.count(a) >= minimum) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(defined, F.try_divide(F.covar_pop(a, b), spread))


def bucket(rank: Column, n: Column, buckets: int) -> Column:
    """ceil(rank / n * buckets), at least 1 and at most ``buckets``."""
    return F.least(F.greatest(F.ceil(rank / n * buckets), F.lit(1)), F.lit(buckets)).cast("int")


def per_group(df: DataFrame, by: Names, aggregates: Names | list[Column], keep: Callable[[DataFrame], DataFrame] = lambda figures: figures) -> DataFrame:
    """df with aggregates of its groups joined back. The groups are few (months): where ``keep`` writes
    their table and reads it back, the planner broadcasts it and the rows are not shuffled."""
    return df.join(keep(df.groupBy(*by).agg(*aggregates)), by, "left")


#: Added before flooring instead of one half: decimal data has its ties at one half, where the
#: last bits of two engines would decide.
OFFSET = 0.4863


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """All doubles cut to the given digits, the same way in every engine."""
    scale = float(10**digits)
    return df.select(*((F.floor(F.col(c) * scale + OFFSET) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
