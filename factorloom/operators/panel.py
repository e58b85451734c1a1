"""Point-in-time panels: calendar, identities, validity intervals, daily bars, execution flags,
month-ends.

Windows over time are partitioned by entity; calendars, identities and histories are joined
without hints, so that the planner broadcasts them only while they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.intervals import only_match

BAR = ["ts_code", "trade_date"]


def trading_calendar(cal: DataFrame) -> DataFrame:
    """Open days of cal(cal_date, is_open), numbered from 1. A calendar has a row for each day
    of history, so one task numbers it."""
    return cal.where("is_open = 1").select("cal_date", F.row_number().over(Window.orderBy("cal_date")).cast("long").alias("open_day_number"))


def code_identity(history: DataFrame) -> DataFrame:
    """Two rows for each code change: the old and the new code, with their canonical code."""
    rest = ["canonical_ts_code", "effective_date", "original_list_date"]
    old = history.select(F.col("old_ts_code").alias("ts_code"), *rest, F.lit("OLD_CODE").alias("security_code_role"))
    return old.union(history.select(F.col("new_ts_code").alias("ts_code"), *rest, F.lit("NEW_CODE").alias("security_code_role")))


def interval_valid(day: Column) -> Column:
    """Whether a day lies on the code's side of its change: old codes before, new ones from it."""
    role, change = F.col("security_code_role"), F.col("effective_date")
    return F.coalesce(F.when(role == "OLD_CODE", day < change).when(role == "NEW_CODE", day >= change).otherwise(True), F.lit(False))


def next_of_calendar(days: DataFrame, calendar: DataFrame, strict: bool = False) -> DataFrame:
    """Each of days(day) with the least value of calendar(day, value) on it or later, or only
    later if ``strict``; null where none follows. Columns are taken by position. A backward fill
    over the union of both; it has a row for each day of history, so one task orders it."""
    (day,), (at, value) = days.columns, calendar.columns
    both = days.select(day, F.lit(True).alias("asked"), F.lit(None).cast(calendar.schema[value].dataType).alias(value))
    both = both.union(calendar.select(at, F.lit(False), value)).groupBy(day).agg(F.max("asked").alias("asked"), F.min(value).alias(value))
    later = Window.orderBy(day).rowsBetween(int(strict), Window.unboundedFollowing)
    return both.select(day, "asked", F.min(value).over(later).alias(value)).where("asked").drop("asked")


def stock_meta(basic: DataFrame, identity: DataFrame, calendar: DataFrame, start: Column) -> DataFrame:
    """Listing reference of every known code. ``start`` is the calendar's first day; the listing
    counts from the first open day on or after the later of both; it ends with the delist date,
    if there is one."""
    codes = basic.select("ts_code").union(identity.select("ts_code")).distinct()
    rows = codes.join(basic.select("ts_code", F.col("list_date").alias("source_list_date"), "delist_date"), "ts_code", "left").join(identity, "ts_code", "left")
    rows = rows.select(
        "ts_code",
        F.coalesce("canonical_ts_code", "ts_code").alias("canonical_ts_code"),
        F.coalesce("original_list_date", "source_list_date").alias("list_date"),
        "delist_date",
        "security_code_role",
        "effective_date",
    )
    first = F.greatest(F.col("list_date"), start)
    # As-of forward: the least open day not before; the next later one of a day that is closed.
    open_days = next_of_calendar(rows.where("list_date is not null").select(first.alias("first")), calendar.select(F.col("cal_date").alias("first"), F.col("open_day_number").alias("listing_start_open_day")))
    return (
        rows.withColumn("first", first)
        .join(open_days, "first", "left")
        .select(
            "*",
            F.col("list_date").isNotNull().alias("has_listing_reference"),
            F.coalesce(F.col("list_date") < start, F.lit(False)).alias("listing_age_is_lower_bound"),
            F.col("security_code_role").isNotNull().alias("has_manual_code_history"),
        )
        .drop("first")
    )


def scd2_history(intervals: DataFrame, value: str, identity: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Distinct validity intervals, closed at both ends; an end after the cutoff is open."""
    last = F.lit(cutoff or "9999-12-31").cast("date")
    rows = intervals.where(F.col("effective_from").isNotNull() & (F.col("effective_from") <= last))
    rows = rows.select("ts_code", value, "effective_from", F.when(F.col("effective_to") <= last, F.col("effective_to")).alias("effective_to")).distinct()
    return rows.join(identity.select("ts_code", "canonical_ts_code"), "ts_code", "left").withColumn("canonical_ts_code", F.coalesce("canonical_ts_code", "ts_code"))


def is_st(name: Column) -> Column:
    return F.upper(name).contains("ST")


def interval_join(left: DataFrame, day: str, history: DataFrame, columns: list[str]) -> DataFrame:
    """left with the columns of the one interval of its code that holds the day; null where none
    does. A second interval that holds it ends the job."""
    return only_match(left, day, history, columns)


def daily_panel(daily: DataFrame, adj: DataFrame, meta: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with adjusted prices, returns within valid code intervals, listing ages and flags."""
    joined = daily.join(adj, BAR, "left").join(meta, "ts_code", "left").join(calendar.withColumnRenamed("cal_date", "trade_date"), "trade_date", "left")
    has_reference = F.coalesce("has_listing_reference", F.lit(False))
    by_code = Window.partitionBy("ts_code").orderBy("trade_date")
    rows = joined.select(
        *daily.columns,
        "adj_factor",
        F.coalesce("canonical_ts_code", "ts_code").alias("canonical_ts_code"),
        "list_date",
        "delist_date",
        "security_code_role",
        "effective_date",
        (F.col("close") * F.col("adj_factor")).alias("close_hfq"),
        (F.col("open") * F.col("adj_factor")).alias("open_hfq"),
        (F.col("vol") * 100).alias("volume_share"),
        (F.col("amount") * 1000).alias("amount_cny"),
        F.split_part("ts_code", F.lit("."), F.lit(2)).isin("SH", "SZ").alias("is_sh_sz"),
        has_reference.alias("has_listing_reference"),
        F.when(has_reference, F.col("trade_date").between(F.col("list_date"), F.coalesce("delist_date", "trade_date"))).otherwise(False).alias("is_within_listing_window"),
        interval_valid(F.col("trade_date")).alias("security_code_interval_valid"),
        F.coalesce("has_manual_code_history", F.lit(False)).alias("has_manual_code_history"),
        F.coalesce("listing_age_is_lower_bound", F.lit(False)).alias("listing_age_is_lower_bound"),
        "open_day_number",
        "listing_start_open_day",
    )
    valid_before = F.coalesce(F.lag("security_code_interval_valid").over(by_code), F.lit(False))
    inside = F.col("is_within_listing_window")
    status = (
        F.when(~F.col("has_listing_reference"), "MISSING_LISTING_REFERENCE")
        .when(~inside, "OUTSIDE_CONFIRMED_LISTING_WINDOW")
        .when(F.col("has_manual_code_history") & F.col("listing_age_is_lower_bound"), "MANUAL_ORIGINAL_LIST_DATE_LOWER_BOUND")
        .when(F.col("has_manual_code_history"), "MANUAL_ORIGINAL_LIST_DATE_EXACT")
        .when(F.col("listing_age_is_lower_bound"), "LOWER_BOUND_CALENDAR_START")
        .otherwise("EXACT_WITHIN_AVAILABLE_CALENDAR")
    )
    return rows.select(
        "*",
        F.lag("close").over(by_code).alias("pre_close"),
        F.when(F.col("security_code_interval_valid") & valid_before, F.col("close_hfq") / F.lag("close_hfq").over(by_code) - 1).alias("daily_return"),
        F.when(inside, F.col("open_day_number") - F.col("listing_start_open_day") + 1).alias("listing_age_trading_days"),
        status.alias("listing_age_status"),
    ).drop("open_day_number", "listing_start_open_day")


def suspend_aggregate(events: DataFrame) -> DataFrame:
    """Suspension events of a code's day: whether suspended, resumed, at which times, and
    whether at the open (no time, or HH:MM-HH:MM around 09:30)."""
    kind, timing = F.upper(F.trim("suspend_type")), F.trim(F.coalesce("suspend_timing", F.lit("")))
    blank = F.when(kind == "S", "FULL_DAY").otherwise("UNSPECIFIED")
    rows = events.select(*BAR, kind.alias("kind"), F.concat(kind, F.lit(":"), F.when(timing == "", blank).otherwise(timing)).alias("event"), F.explode(F.split(timing, ",")).alias("segment"))
    segment = F.trim("segment")
    spans = (F.length(segment) == 11) & (F.split_part(segment, F.lit("-"), F.lit(1)) <= "09:30") & (F.split_part(segment, F.lit("-"), F.lit(2)) >= "09:30")
    at_open = (F.col("kind") == "S") & ((segment == "") | spans)
    return rows.groupBy(*BAR).agg(
        F.bool_or(F.col("kind") == "S").alias("has_suspend_s"),
        F.bool_or(F.col("kind") == "R").alias("has_resume_r"),
        F.array_join(F.sort_array(F.collect_set("event")), "|").alias("suspend_intervals"),
        F.bool_or(at_open).alias("suspended_at_open"),
    )


def execution_status(panel: DataFrame, limits: DataFrame, suspended: DataFrame, identity: DataFrame) -> DataFrame:
    """Whether a code could be bought or sold at the open of a day, and why not."""
    keys = panel.select(*BAR).union(limits.select(*BAR)).union(suspended.select(*BAR)).distinct()
    bars = panel.select(*BAR, F.col("open").alias("open_price"), F.col("close").alias("__close"), F.col("canonical_ts_code").alias("__bar_code"))
    names = identity.select("ts_code", "security_code_role", "effective_date", F.col("canonical_ts_code").alias("__map_code"))
    joined = keys.join(bars, BAR, "left").join(limits, BAR, "left").join(suspended.withColumn("__suspended", F.lit(True)), BAR, "left").join(names, "ts_code", "left")
    priced = F.col("open_price").isNotNull() & F.col("__close").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    price = F.col("open_price")
    at_up = yes(priced & ((F.round(price, 2) >= F.round("up_limit", 2)) | (F.abs(price - F.col("up_limit")) <= 0.005)))
    at_down = yes(priced & ((F.round(price, 2) <= F.round("down_limit", 2)) | (F.abs(price - F.col("down_limit")) <= 0.005)))
    rows = joined.select(
        *BAR,
        F.coalesce("__bar_code", "__map_code", "ts_code").alias("canonical_ts_code"),
        "open_price",
        priced.alias("has_daily_price"),
        yes(F.col("__suspended")).alias("has_suspend_record"),
        yes(F.col("has_suspend_s")).alias("has_suspend_s"),
        yes(F.col("has_resume_r")).alias("has_resume_r"),
        "suspend_intervals",
        yes(F.col("suspended_at_open")).alias("suspended_at_open"),
        "up_limit",
        "down_limit",
        at_up.alias("open_at_up_limit"),
        at_down.alias("open_at_down_limit"),
        interval_valid(F.col("trade_date")).alias("security_code_interval_valid"),
    )
    blocked = ~F.col("has_daily_price") | F.col("suspended_at_open")
    reasons = [(~F.col("has_daily_price"), "NO_DAILY_PRICE"), (F.col("suspended_at_open"), "SUSPENDED_AT_OPEN"), (F.col("open_at_up_limit"), "OPEN_AT_UP_LIMIT"), (F.col("open_at_down_limit"), "OPEN_AT_DOWN_LIMIT")]
    return rows.select(
        "*",
        (~F.col("security_code_interval_valid")).alias("invalid_security_code_interval"),
        (blocked | F.col("open_at_up_limit")).alias("cannot_buy_at_open"),
        (blocked | F.col("open_at_down_limit")).alias("cannot_sell_at_open"),
        F.nullif(F.concat_ws("|", *(F.when(c, F.lit(r)) for c, r in reasons)), F.lit("")).alias("execution_block_reason"),
    )


def month_end_panel(month_end: DataFrame, panel: DataFrame, industry: DataFrame, names: DataFrame, liquidity_window: int = 20, history: int = 252) -> DataFrame:
    """Month-end rows with rolling metrics of their bar and the industry and name valid then."""
    usable = F.col("is_within_listing_window") & F.col("security_code_interval_valid")
    so_far = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    recent = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(1 - liquidity_window, 0)
    amount = F.when(usable, F.col("amount_cny"))
    metrics = panel.select(
        "ts_code",
        F.col("trade_date").alias("asof_trade_date"),
        *("canonical_ts_code", "listing_age_trading_days", "listing_age_status", "has_listing_reference", "is_within_listing_window", "security_code_interval_valid", "is_sh_sz"),
        F.count(F.when(usable, 1)).over(so_far).alias("available_history_observations"),
        F.when(F.count(amount).over(recent) == liquidity_window, F.avg(amount).over(recent)).alias("liquidity_20d"),
    )
    rows = month_end.join(metrics, ["ts_code", "asof_trade_date"])
    rows = interval_join(rows, "signal_date", industry, ["industry_code"])
    rows = interval_join(rows, "signal_date", names.withColumn("is_st_name_flag", is_st(F.col("stock_name"))), ["stock_name", "is_st_name_flag"])
    return rows.select(
        "*",
        (F.col("available_history_observations") >= history).alias("has_enough_252d_history"),
        (F.col("total_mv") * 10000).alias("total_mv_cny"),
        F.col("industry_code").isNotNull().alias("has_industry_history"),
    )


def benchmark_returns(series: DataFrame) -> DataFrame:
    """Return of each benchmark's close over the day before."""
    order = Window.partitionBy("benchmark_code").orderBy("trade_date")
    return series.select("benchmark_code", "trade_date", "close", (F.col("close") / F.lag("close").over(order) - 1).alias("benchmark_return"))


def code_boundary(history: DataFrame, panel: DataFrame) -> DataFrame:
    """What each code change looks like in the bars: last old and first new valid bar, gaps,
    raw ranges, bars of the new code before its time, and duplicate days of the entity."""
    key = ["old_ts_code", "new_ts_code"]
    roles = history.select(*key, "effective_date", F.explode(F.array(F.struct(F.lit("OLD").alias("role"), F.col("old_ts_code").alias("ts_code")), F.struct(F.lit("NEW").alias("role"), F.col("new_ts_code").alias("ts_code")))).alias("x")).select(*key, "effective_date", "x.*")
    bars = roles.join(panel.select(*BAR, "close", "pre_close", "adj_factor", "security_code_interval_valid"), "ts_code", "left")
    old, new, day = F.col("role") == "OLD", F.col("role") == "NEW", F.col("trade_date")
    last = F.max_by(F.struct("trade_date", "close", "adj_factor"), F.when(old & F.col("security_code_interval_valid") & (day < F.col("effective_date")), day))
    first = F.min_by(F.struct("trade_date", "pre_close", "close", "adj_factor"), F.when(new & F.col("security_code_interval_valid") & (day >= F.col("effective_date")), day))
    ends = bars.groupBy(*key).agg(
        last.alias("o"),
        first.alias("n"),
        F.min(F.when(old, day)).alias("old_raw_first_date"),
        F.max(F.when(old, day)).alias("old_raw_last_date"),
        F.min(F.when(new, day)).alias("new_raw_first_date"),
        F.max(F.when(new, day)).alias("new_raw_last_date"),
        F.count(F.when(new & (day < F.col("effective_date")), 1)).alias("new_code_backfill_rows"),
    )
    valid = F.col("security_code_interval_valid")
    same = history.select(*key, "canonical_ts_code").join(panel.select("canonical_ts_code", "trade_date", "security_code_interval_valid"), "canonical_ts_code", "left")
    days = same.groupBy(*key, "trade_date").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(valid, 1)).alias("valid_bars"))
    twice = days.groupBy(*key).agg(
        F.sum(F.col("bars") - 1).alias("raw_canonical_duplicate_rows"),
        F.sum(F.greatest(F.col("valid_bars") - 1, F.lit(0))).alias("valid_canonical_duplicate_rows"),
    )
    return (
        history.select(*key, "canonical_ts_code", "effective_date")
        .join(ends, key)
        .join(twice, key)
        .select(
            *(*key, "canonical_ts_code", "effective_date"),
            F.col("o.trade_date").alias("old_last_trade_date"),
            F.col("n.trade_date").alias("new_first_trade_date"),
            F.col("o.close").alias("old_last_close"),
            F.col("n.pre_close").alias("new_first_pre_close"),
            F.col("n.close").alias("new_first_close"),
            (F.col("n.pre_close") - F.col("o.close")).alias("pre_close_minus_old_close"),
            F.abs(F.col("n.adj_factor") / F.col("o.adj_factor") - 1).alias("adj_factor_relative_difference"),
            (F.col("n.close") * F.col("n.adj_factor") / (F.col("o.close") * F.col("o.adj_factor")) - 1).alias("adjusted_boundary_return"),
            *("old_raw_first_date", "old_raw_last_date", "new_raw_first_date", "new_raw_last_date", "new_code_backfill_rows", "raw_canonical_duplicate_rows", "valid_canonical_duplicate_rows"),
        )
    )


def code_boundary_tests(boundary: DataFrame, price_tolerance: float = 0.005, adj_tolerance: float = 0.001, most_duplicates: int = 0) -> DataFrame:
    """Six tests of each code change in long form, with the verdict over all six."""
    tests = {
        "OLD_LAST_TRADE_DATE": F.col("old_last_trade_date") < F.col("effective_date"),
        "NEW_FIRST_TRADE_DATE": F.col("new_first_trade_date") == F.col("effective_date"),
        "NEW_FIRST_PRE_CLOSE_VS_OLD_CLOSE": F.abs("pre_close_minus_old_close") <= price_tolerance,
        "OLD_LAST_CLOSE": F.col("old_last_close") > 0,
        "ADJ_FACTOR_BOUNDARY": F.col("adj_factor_relative_difference") <= adj_tolerance,
        "CANONICAL_DUPLICATE_DATES": F.col("valid_canonical_duplicate_rows") <= most_duplicates,
    }
    passed = {t: F.coalesce(c, F.lit(False)) for t, c in tests.items()}
    verdict = F.when(F.array_min(F.array(*passed.values())), "PASS").otherwise("FAIL")
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("test_name"), F.when(c, "PASS").otherwise("FAIL").alias("status")) for t, c in passed.items())))
    return boundary.select("old_ts_code", "new_ts_code", "canonical_ts_code", verdict.alias("boundary_status"), rows.alias("t")).select("old_ts_code", "new_ts_code", "canonical_ts_code", "boundary_status", "t.*")


def sample_join_audit(status: DataFrame, industry: DataFrame, names: DataFrame, dates: list[str]) -> DataFrame:
    """One row for each date and category: the first eligible code in a fixed order, or a
    placeholder where none is eligible."""
    days = F.col("trade_date").isin([F.lit(d).cast("date") for d in dates])
    rows = status.where(days)
    rows = interval_join(rows, "trade_date", industry, ["industry_code"])
    rows = interval_join(rows, "trade_date", names, ["stock_name"])

    def known(history: DataFrame, value: str, name: str) -> DataFrame:
        """Distinct values that a code has had by each date: those whose first start is not later."""
        first = history.where(F.col(value).isNotNull() & F.col("effective_from").isNotNull()).groupBy("ts_code", value).agg(F.min("effective_from").alias("first"))
        later = F.filter(F.array(*(F.lit(d).cast("date") for d in dates)), lambda d: d >= F.col("first"))
        return first.select("ts_code", F.explode(later).alias("trade_date")).groupBy("ts_code", "trade_date").agg(F.count(F.lit(1)).alias(name))

    rows = rows.join(known(names, "stock_name", "names_known"), BAR, "left").join(known(industry, "industry_code", "industries_known"), BAR, "left").na.fill(0, ["names_known", "industries_known"])
    price, buy, sell = F.col("has_daily_price"), F.col("cannot_buy_at_open"), F.col("cannot_sell_at_open")
    zero = F.lit(0).cast("long")
    categories = {
        "NORMAL": (price & ~buy & ~sell, zero, zero),
        "SUSPENDED_OR_NO_PRICE": (~price | F.col("suspended_at_open"), F.col("suspended_at_open").cast("long"), F.col("has_suspend_record").cast("long")),
        "NAME_CHANGED_STOCK": (price & (F.col("names_known") > 1) & F.col("stock_name").isNotNull(), F.col("names_known"), zero),
        "INDUSTRY_CHANGED_STOCK": (price & (F.col("industries_known") > 1) & F.col("industry_code").isNotNull(), F.col("industries_known"), zero),
    }
    options = F.array(*(F.struct(F.lit(n).alias("sample_category"), c.alias("fits"), a.alias("first"), b.alias("second")) for n, (c, a, b) in categories.items()))
    joined = F.concat_ws("|", F.when(F.col("stock_name").isNotNull(), "NAME_JOINED").otherwise("NAME_MISSING"), F.when(F.col("industry_code").isNotNull(), "INDUSTRY_JOINED").otherwise("INDUSTRY_MISSING"))
    eligible = rows.select("trade_date", "ts_code", joined.alias("join_status"), F.explode(options).alias("o")).where("o.fits").select("trade_date", "ts_code", "join_status", "o.*")
    order = Window.partitionBy("trade_date", "sample_category").orderBy(F.desc("first"), F.desc("second"), "ts_code")
    chosen = eligible.withColumn("n", F.row_number().over(order)).where("n = 1")
    spark = status.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*(F.lit(d).cast("date") for d in dates))).alias("audit_date")).select("audit_date", F.explode(F.array(*map(F.lit, categories))).alias("sample_category"))
    found = chosen.select(F.col("trade_date").alias("audit_date"), "sample_category", "ts_code", "join_status")
    return grid.join(found, ["audit_date", "sample_category"], "left").withColumn("join_status", F.coalesce("join_status", F.lit("NO_ELIGIBLE_SAMPLE")))
