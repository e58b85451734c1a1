"""Handed-over tables in buckets of the code: no exchange of the large side in windows and joins."""

import re

from factorloom.operators import factors, panel
from factorloom.plans.panels import panels

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_execution_status_and_factors_exchange_nothing_by_code(spark):
    p = panels(spark, SF)
    assert _exchanges(panel.execution_status(p.daily, p["b_limit"], p.suspended, p.identity)) == []
    assert _exchanges(factors.daily_features(p.entity_bars)) == []


def test_without_broadcasts_only_dimensions_are_exchanged(spark):
    p = panels(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = p["b_daily"].join(p["b_adj"], ["ts_code", "trade_date"])
        assert _exchanges(plan) == []
        joined = p.daily.join(p.status.drop("canonical_ts_code", "security_code_interval_valid"), ["ts_code", "trade_date"])
        assert _exchanges(joined) == [] and joined.count() == p.daily.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
