"""Validity intervals closed at both ends: overlapping pairs by a sweep, and look-ups that hold
exactly one interval for each row.

Defined results: an open end (null) lasts for ever; an interval without a start takes no part; an
interval that ends before it starts holds no day, so it is in no pair and matches nothing; equal
intervals overlap each other; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

_EVER = "9999-12-31"


def _closed(history: DataFrame) -> DataFrame:
    return history.withColumn("__end", F.coalesce("effective_to", F.lit(_EVER).cast("date"))).where("effective_from is not null and __end >= effective_from")


def overlapping_pairs(history: DataFrame, by: list[str], days_per_bucket: int = 512) -> DataFrame:
    """For each key of history(by, effective_from, effective_to) with an interval: intervals and
    pairs of intervals that share a day.

    A sweep over starts and ends: an interval overlaps those that are open when it starts. Starts
    and ends are counted by day, cut into buckets of days, and running sums go within buckets and
    over buckets, so a key with very many intervals is no single task's work. No pair is made."""
    whole = _closed(history)
    ends = F.array(F.struct(F.unix_date("effective_from").alias("day"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct((F.unix_date("__end") + 1).alias("day"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    by_day = whole.select(*by, F.explode(ends).alias("e")).groupBy(*by, "e.day").agg(F.sum("e.starts").alias("starts"), F.sum("e.ends").alias("ends")).withColumn("bucket", F.floor(F.col("day") / days_per_bucket))
    totals = by_day.groupBy(*by, "bucket").agg((F.sum("starts") - F.sum("ends")).alias("change"))
    line = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "bucket", F.coalesce(F.sum("change").over(line), F.lit(0)).alias("open_before"))
    inside = Window.partitionBy(*by, "bucket").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # Ends count on the day after the last, so they are over before the starts of that day.
    swept = by_day.withColumns({"started": F.sum("starts").over(inside) - F.col("starts"), "ended": F.sum("ends").over(inside)})
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "bucket"]]
    rows = swept.alias("a").join(totals.alias("b"), on).select(*(F.col(f"a.{c}") for c in [*by, "starts", "started", "ended"]), "b.open_before")
    still = F.col("open_before") + F.col("started") - F.col("ended")
    # With those open already, and among the day's own starts.
    pairs = F.col("starts") * still + F.col("starts") * (F.col("starts") - 1) / 2
    return rows.groupBy(*by).agg(F.sum("starts").alias("intervals"), F.sum(pairs).cast("long").alias("overlapping_pairs"))


def matches_of(left: DataFrame, day: str, history: DataFrame, columns: list[str], code: str = "ts_code") -> DataFrame:
    """left with the columns of the interval of its code that holds the day (null where none
    does) and ``matches``, the number of intervals that hold it; of several the one that ends last.

    One ordered pass over starts, ends and rows of a code instead of a join by inequality: the
    running sum of starts less ends is the number of open intervals, and if one is open, so is that
    of the latest end. Rows of a code are days, so a code's pass is bounded by the calendar."""
    whole = _closed(history)
    held = F.struct(F.col("__end").alias("end"), F.col("effective_from").alias("start"), *columns)
    mark = lambda at, order, change: (F.col(code).alias("__code"), at.alias("__day"), F.lit(order).alias("__order"), F.lit(change).alias("__change"))
    ends = whole.select(*mark(F.date_add("__end", 1), 0, -1))
    starts = whole.select(*mark(F.col("effective_from"), 1, 1), held.alias("__held"))
    rows = left.select(*mark(F.col(day), 2, 0), F.struct(*left.columns).alias("__row"))
    line = ends.unionByName(starts, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("__code").orderBy("__day", "__order").rowsBetween(Window.unboundedPreceding, 0)
    passed = line.withColumns({"__open": F.sum("__change").over(order), "__latest": F.max("__held").over(order)}).where("__order = 2")
    known = F.col("__code").isNotNull() & F.col("__day").isNotNull()
    matches = F.when(known, F.col("__open")).otherwise(F.lit(0)).cast("long")
    return passed.select("__row.*", *(F.when(known & (F.col("__open") > 0), F.col(f"__latest.{c}")).alias(c) for c in columns), matches.alias("matches"))


def _refused(day: str, code: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"more than one interval holds {day} of "), F.col(code).cast("string")))


def only_match(left: DataFrame, day: str, history: DataFrame, columns: list[str], code: str = "ts_code") -> DataFrame:
    """``matches_of`` without its count, where a second match ends the job."""
    sure = F.when(F.col("matches") > 1, _refused(day, code).cast("boolean")).otherwise(F.lit(True))
    return matches_of(left, day, history, columns, code).where(sure).drop("matches")


def single_match(left: DataFrame, day: str, history: DataFrame, columns: list[str], strict: bool = False, code: str = "ts_code") -> tuple[DataFrame, Observation]:
    """``matches_of`` without its count, which an observation gives once the result has been
    read: rows, unmatched and ambiguous, in the same pass. Read it into a table first: a global sort
    behind it samples the rows and would count them twice. With ``strict`` an ambiguous row
    ends the job."""
    seen = Observation()
    rows = matches_of(left, day, history, columns, code)
    two = F.col("matches") > 1
    if strict:
        rows = rows.withColumn("matches", F.when(two, _refused(day, code).cast("long")).otherwise(F.col("matches")))
    counts: list[Column] = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("matches") == 0).alias("unmatched"), F.count_if(F.col("matches") > 1).alias("ambiguous")]
    return rows.observe(seen, *counts).drop("matches"), seen
