"""The operators' inputs over the test tables, built lazily and once for each session and folder.

Each step that others start from is written to the shared folder once and read back, so a query
plans its own step only."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import diagnostics, factors, panel, portfolio, robustness
from factorloom.operators.factors import FactorRules
from factorloom.sources.bindings import TABLES, bound
from factorloom.sources.tables import CO_PARTITION, INITIAL, file_state, hand_over, hand_over_bucketed, parts_for, remove_folder, shared_folder


def capital_of(orders: DataFrame) -> DataFrame:
    """Each portfolio's cash at the beginning: that for all its buys and a tenth more."""
    bought = F.sum(F.when(F.col("side") == "BUY", F.col("executed_notional")).otherwise(0.0))
    return orders.groupBy("portfolio_id").agg((bought * 1.1 + 1).alias("initial_capital"))


class Panels:
    def __init__(self, spark: SparkSession, sf_dir: str, parts: int | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._by_rules: dict[FactorRules, DataFrame] = {}
        self._signals: dict[int, DataFrame] = {}
        self._made: dict[str, str] = {}
        self._steps: dict[str, DataFrame] = {}
        self._bound: dict[str, DataFrame] = {}
        self._tables: list[str] = []
        spark.conf.set(CO_PARTITION, "false")
        self.folder = f"{shared_folder(spark)}/panels-{uuid.uuid4().hex}"

    def __getitem__(self, name: str) -> DataFrame:
        return bound(self.spark, self.sf_dir, name, self._bound, self._keep, self._by_code, self.parts)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return hand_over(df, name, self.folder)

    def _by_code(self, df: DataFrame, name: str, column: str = "ts_code", dealt: bool = False) -> DataFrame:
        """A table with a row for each code and day, in buckets of the code."""
        made, table = hand_over_bucketed(df, name, self.folder, column, self.parts, dealt)
        self._tables.append(table)
        return made

    def discard(self) -> None:
        """Remove all tables written for these inputs."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_folder(self.spark, self.folder)

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step's table, written at its first use."""
        if name not in self._steps:
            self._steps[name] = self._keep(build(), name)
        return self._steps[name]

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step's frame, not written: its readers make it anew from tables that are."""
        if name not in self._steps:
            self._steps[name] = build()
        return self._steps[name]

    def made(self, name: str, make: Callable[[], str]) -> str:
        """The path of a file that is written at its first use."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @cached_property
    def calendar(self) -> DataFrame:
        return self._keep(panel.trading_calendar(self["b_trade_cal"]), "calendar")

    @cached_property
    def identity(self) -> DataFrame:
        return self._keep(panel.code_identity(self["b_code_history"]), "identity")

    @cached_property
    def meta(self) -> DataFrame:
        return self._keep(panel.stock_meta(self["b_stock_basic"], self.identity, self.calendar, F.lit("1995-01-01").cast("date")), "meta")

    def _daily_plan(self) -> DataFrame:
        return panel.daily_panel(self["b_daily"], self["b_adj"], self.meta, self.calendar)

    @cached_property
    def daily(self) -> DataFrame:
        return self._by_code(self._daily_plan(), "daily")

    def day_rows(self) -> DataFrame:
        """The daily panel for steps that read a few of its columns: its table where a query has
        written it, else its plan over the bars' buckets, so that the other columns are neither made
        nor written."""
        return self.daily if "daily" in self.__dict__ else self._daily_plan()

    @cached_property
    def suspended(self) -> DataFrame:
        return panel.suspend_aggregate(self["b_suspend"])

    @cached_property
    def status(self) -> DataFrame:
        return self._by_code(panel.execution_status(self.daily, self["b_limit"], self.suspended, self.identity), "status")

    def status_on(self, days: DataFrame) -> DataFrame:
        """The execution status on days(trade_date) only, bounded by the calendar: from its table where a query has
        written it, else over the bars' buckets, so that the other days are not written."""
        on = lambda df: df.join(F.broadcast(days.select("trade_date").distinct()), "trade_date", "left_semi")
        if "status" in self.__dict__:
            return on(self.status).select(self.status.columns)
        return panel.execution_status(on(self.day_rows()), on(self["b_limit"]), on(self.suspended), self.identity)

    @cached_property
    def industry(self) -> DataFrame:
        return self._keep(panel.scd2_history(self["b_industry_history"], "industry_code", self.identity), "industry")

    @cached_property
    def names(self) -> DataFrame:
        return self._keep(panel.scd2_history(self["b_name_history"], "stock_name", self.identity), "names")

    @cached_property
    def monthly(self) -> DataFrame:
        return self._keep(panel.month_end_panel(self["b_month_end"], self.day_rows(), self.industry, self.names), "monthly")

    def factors(self, rules: FactorRules = FactorRules()) -> DataFrame:
        """The factor panel under the rules: a row for each entity and month."""
        if rules not in self._by_rules:
            self._by_rules[rules] = self._keep(factors.scored(self.raw_for(rules), rules, self._keep), "factor_panel")
        return self._by_rules[rules]

    def raw_for(self, rules: FactorRules) -> DataFrame:
        """Raw factors; rules that differ in the universe only share them."""
        spans = (rules.recent_skip, rules.lookback, rules.volatility_window, rules.liquidity_window)
        return self.step("raw_" + "_".join(map(str, spans)), lambda: factors.raw_factors(self.monthly, factors.daily_features(self.entity_bars, rules), rules))

    @cached_property
    def entity_bars(self) -> DataFrame:
        """What factors read of the bars that they are made of, in buckets of the entity that windows over
        time go by."""
        columns = ["ts_code", "canonical_ts_code", "trade_date", "close_hfq", "amount_cny", "is_sh_sz", "is_within_listing_window", "security_code_interval_valid"]
        return self._by_code(self.day_rows().where(factors.VALID_BAR).select(*columns), "entity_bars", "canonical_ts_code")

    @cached_property
    def raw(self) -> DataFrame:
        return self.raw_for(FactorRules())

    @cached_property
    def factor_panel(self) -> DataFrame:
        return self.factors()

    @cached_property
    def ic(self) -> DataFrame:
        return self._keep(diagnostics.monthly_rank_ic(self.factor_panel), "ic")

    @cached_property
    def quintiles(self) -> DataFrame:
        return self._keep(diagnostics.quintile_returns(self.factor_panel), "quintiles")

    @cached_property
    def targets(self) -> DataFrame:
        return self._keep(portfolio.composite_topn(self.factor_panel, 20), "targets")

    def variant_signals(self, variants: Callable[[Panels], dict[str, DataFrame]], k: int) -> DataFrame:
        if k not in self._signals:
            self._signals[k] = self._keep(robustness.variant_signals(variants(self), k), "variant_signals")
        return self._signals[k]

    @cached_property
    def schedule(self) -> DataFrame:
        return self._keep(portfolio.rebalance_schedule(self["b_month_end"], self["b_benchmark"]), "schedule")

    @cached_property
    def nav(self) -> DataFrame:
        return self._keep(portfolio.nav_daily(self["b_returns"]), "nav")

    @cached_property
    def stale(self) -> DataFrame:
        """Positions on every market day; a position is known by portfolio and supplier. Not
        written: its rows are positions times days, and every reader makes them anew from the ledger."""
        key = ["portfolio_id", "suppkey"]
        return portfolio.stale_valuation(self.ledger, self["b_daily"], self["b_benchmark"], key, "suppkey")

    @cached_property
    def ledger(self) -> DataFrame:
        """In buckets of the supplier, with one exchange: nearly every order is its position's only one of its day."""
        orders = self["b_orders"].repartition(self.parts, "suppkey")
        return self._by_code(portfolio.position_ledger(orders, ["portfolio_id", "suppkey"]), "ledger", "suppkey", dealt=True)

    @cached_property
    def capital(self) -> DataFrame:
        return capital_of(self["b_orders"])

    @cached_property
    def cash(self) -> DataFrame:
        """What of the accounts does not depend on the positions of every market day."""
        return self._keep(portfolio.account_cash(self["b_orders"], self["b_benchmark"], self["b_scenarios"], self["b_fees"], self.capital), "cash")

    @cached_property
    def accounts(self) -> DataFrame:
        return self._keep(portfolio.account_daily(self["b_orders"], self.stale, self["b_benchmark"], self["b_scenarios"], self["b_fees"], self.capital), "accounts")


#: Tables that the panels' rows come from.
GROWING = ("lineitem", "orders", "events")
#: Inputs whose tables are kept at a time.
KEPT = 8
_PANELS: OrderedDict[tuple[SparkSession, str], tuple[tuple, Panels]] = OrderedDict()


def panels(spark: SparkSession, sf_dir: str) -> Panels:
    """The panels over a folder, made anew when a table's files there have changed. Tables of the old
    state, and those of the folder not used for the longest time, are removed; results
    that were not read by then can no longer be."""
    state, key = file_state(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]), (spark, sf_dir)
    before, found = _PANELS.pop(key, (None, None))
    if before != state:
        if found is not None:
            found.discard()
        found = Panels(spark, sf_dir, parts_for(spark, file_state(spark, [f"{sf_dir}/{t}.parquet" for t in GROWING])))
    spark.conf.set(INITIAL, str(found.parts))
    _PANELS[key] = (state, found)
    while len(_PANELS) > KEPT:
        _PANELS.popitem(last=False)[1][1].discard()
    return found
