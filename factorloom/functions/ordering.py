"""Order statistics of large groups: running counts, exact quantiles and average ranks without a
task that holds a group.

Values are dealt to buckets by a fixed function that never decreases with the value: 256 buckets
for each power of two, and so for negative values the other way round. Counts of whole buckets
come before a bucket's own values, so windows run within buckets and over buckets, never over a
group. Equal values are counted before they are shuffled. No sampling decides the buckets, so a
lost task gives the same ones again.

Defined results: nulls take no part; NaN is above all numbers; negative and positive zero are
equal; a group without values has no quantiles and no ranks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_OCTAVE, _LOWEST, _TOP = 256, 1075, 1 << 30


def radix(value: Column) -> Column:
    """The bucket of a number: never smaller for a greater value. Logarithms from the least
    denormal (-1074) on are shifted to be positive."""
    x = value.cast("double")
    octave = F.floor((F.log2(F.abs(x)) + _LOWEST) * _PER_OCTAVE)
    return F.when(F.isnan(x), F.lit(_TOP)).when(F.abs(x) == float("inf"), F.signum(x) * (_TOP - 1)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * octave).cast("int")


def running_totals(counted: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Rows of distinct (by, value) with the sum of ``n`` over all smaller values of the group
    (``before``) and over the group (``total``)."""
    dealt = counted.withColumn("__bucket", radix(F.col(value)))
    sums = dealt.groupBy(*by, "__bucket").agg(F.sum(n).alias("__here"))
    # One row for each bucket of a group: at most some hundred for each power of two in use.
    line = Window.partitionBy(*by).orderBy("__bucket")
    sums = sums.withColumns({"__ahead": F.sum("__here").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__here"), "total": F.sum("__here").over(Window.partitionBy(*by))})
    inside = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("__so_far", F.sum(n).over(inside))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] + [F.col("r.__bucket") == F.col("s.__bucket")]
    joined = rows.alias("r").join(sums.alias("s"), on)
    return joined.select(*(F.col(f"r.{c}") for c in counted.columns), (F.col("s.__ahead") + F.col("r.__so_far") - F.col(f"r.{n}")).alias("before"), F.col("s.total").alias("total"))


def value_counts(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Distinct values of each group and how often they occur."""
    return df.select(*by, value.cast("double").alias("value")).where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, by: list[str], values: dict[str, Column], probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles, one row for each group: column ``<value>_<probability>`` for
    each name of both. Two rounds for all values at once: a histogram over buckets says in which of
    them the wanted ranks lie, and only values of these buckets are ordered."""
    options = F.array(*(F.struct(F.lit(k).alias("of"), c.cast("double").alias("value")) for k, c in values.items()))
    key = [*by, "of"]
    long = df.select(*by, F.explode(options).alias("v")).select(*by, "v.*").where("value is not null").withColumn("bucket", radix(F.col("value")))
    line = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = long.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = histogram.withColumns({"before": F.sum("n").over(line) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*key))})

    def at(q: float) -> Column:
        return (F.col("total") - 1) * F.lit(q)

    def holds(k: Column) -> Column:
        return (F.col("before") <= k) & (k < F.col("before") + F.col("n"))

    wanted = reduce(Column.__or__, (holds(r(at(q))) for q in probabilities.values() for r in (F.floor, F.ceil)))
    chosen = histogram.where(wanted).select(*(F.col(c).alias(f"__{c}") for c in [*key, "bucket"]), F.col("before").alias("ahead"), "total")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*key, "bucket"]]
    narrowed = long.join(chosen, on).groupBy(*key, "bucket", "ahead", "total", "value").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*key, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = narrowed.withColumn("before", F.col("ahead") + F.sum("n").over(inside) - F.col("n"))
    aggregates = []
    for name, q in probabilities.items():
        low, high = F.floor(at(q)), F.ceil(at(q))
        aggregates += [F.max(F.when(holds(low), F.col("value"))).alias(f"__lo_{name}"), F.max(F.when(holds(high), F.col("value"))).alias(f"__hi_{name}"), F.max(at(q) - low).alias(f"__up_{name}"), F.max(high - at(q)).alias(f"__down_{name}")]
    by_value = ranked.groupBy(*key).agg(*aggregates)

    def between(name: str) -> Column:
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when(low == high, low).otherwise(F.col(f"__down_{name}") * low + F.col(f"__up_{name}") * high)

    return by_value.groupBy(*by).agg(*(F.max(F.when(F.col("of") == k, between(name))).alias(f"{k}_{name}") for k in values for name in probabilities))


def average_ranks(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Distinct values of each group with their average rank from 1 (``average_rank``), the rows
    below (``before``), equal (``n``) and in all (``total``)."""
    rows = running_totals(value_counts(df, by, value), by, "value", "n")
    return rows.withColumn("average_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def with_quantiles(df: DataFrame, by: list[str], values: dict[str, Column], probabilities: dict[str, float], keep: Callable[[DataFrame], DataFrame] = lambda figures: figures) -> DataFrame:
    """df with the quantiles of its groups, whose keys are not null; a row for each group is joined.
    ``keep`` may write these rows and read them back: the planner then knows that they are few and
    broadcasts them, while the size of an aggregate is known only after df was shuffled for the join."""
    return df.join(keep(quantiles(df, by, values, probabilities)), by, "left")


def with_average_ranks(df: DataFrame, by: list[str], values: dict[str, Column], total: str | None = None) -> DataFrame:
    """df with the average rank of each value in its group (keys not null), by the name given, and,
    if asked for, the number of ranked rows of the first; null where the value is. Ranks are taken
    from df itself, so several cost no more than one each."""
    marked = df.withColumns({f"__{name}": value.cast("double") for name, value in values.items()})
    out = marked
    for i, name in enumerate(values):
        ranks = average_ranks(marked.select(*by, f"__{name}"), by, F.col(f"__{name}"))
        more = [F.col("total").alias(total)] if total and i == 0 else []
        out = out.join(ranks.select(*by, F.col("value").alias(f"__{name}"), F.col("average_rank").alias(name), *more), [*by, f"__{name}"], "left")
    return out.drop(*(f"__{name}" for name in values))
