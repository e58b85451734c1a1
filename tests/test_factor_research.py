"""Operators against their SQL twins on the smallest data, and formulas on made fixtures."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.sources import fingerprints as fp
from factorloom.functions.stats import average_rank, bucket, safe_corr
from factorloom.operators import panel as pn
from factorloom.operators import performance as pf
from factorloom.operators import portfolio as po
from factorloom.operators import quality as qa
from factorloom.plans import registry
from factorloom.sources import tables as src
from factorloom.sources.bindings import TABLES

SF = "/root/testdata/sf0.001"
CHECKED = ["trading_calendar", "listing_age", "daily_panel", "interval_join", "suspend_aggregate", "execution_status", "code_boundary", "monthly_rank_ic", "composite_topn", "trade_costs", "cash_scaling", "period_performance", "drawdown_episode", "dq_execution", "input_inventory"]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) or x is pd.NA:
            return "null"
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return f"{float(x):.6g}"
        return str(x)[:10] if hasattr(x, "year") else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql_twin(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    assert sum(x != y for x, y in zip(a, b, strict=True)) == 0


def test_every_oracle_parses_and_names_the_same_columns(spark, duck):
    built, sql = registry.queries(), registry.oracle_sql()
    for name in sql:
        assert sorted(built[name](spark, SF).columns) == sorted(duck.sql(sql[name]).columns), name


def test_average_rank_shares_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0)], "g string, x double")
    rows = df.select("g", "x", average_rank(F.col("x"), ["g"], F.col("x").isNotNull()).alias("r")).collect()
    assert sorted((r.g, r.x, r.r) for r in rows if r.x is not None) == [("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("b", 5.0, 1.0)]
    assert [r.r for r in rows if r.x is None] == [None]


def test_safe_corr_of_constant_or_few_rows_is_null(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(6)] + [("f", float(i), float(i)) for i in range(3)] + [("l", float(i), 2.0 * i) for i in range(6)], "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(safe_corr(F.col("x"), F.col("y"), 5).alias("c")).collect()}
    assert got["c"] is None and got["f"] is None and got["l"] == pytest.approx(1.0)


def test_bucket_is_clipped(spark):
    df = spark.createDataFrame([(1.0, 10), (2.5, 10), (10.0, 10)], "r double, n int")
    assert [x.q for x in df.select(bucket(F.col("r"), F.col("n"), 5).alias("q")).collect()] == [1, 2, 5]


def test_annualisation_follows_published_figures(spark):
    total, days, annual = 0.358547, 969, 0.082948
    assert (1 + total) ** (252 / days) - 1 == pytest.approx(annual, abs=1e-6)
    assert 0.063298 / 0.158889 * math.sqrt(12) == pytest.approx(1.38003, abs=1e-4)


def test_nav_starts_at_one_and_period_counts_its_first_day(spark):
    returns = spark.sql("SELECT * FROM VALUES ('S', date'2020-01-01', -0.5D, 0.0D), ('S', date'2020-01-02', 0.1D, 0.0D) AS t(cost_scenario, trade_date, strategy_daily_return, benchmark_daily_return)")
    nav = po.nav_daily(returns).orderBy("trade_date").collect()
    assert [round(r.strategy_nav, 9) for r in nav] == [1.0, 1.1]
    period = pf.period_performance(returns, [("P", "2020-01-01", "2020-12-31")]).first()
    assert period.strategy_total_return == pytest.approx(0.5 * 1.1 - 1) and period.strategy_max_drawdown == 0


def test_interval_join_is_closed_on_both_ends(spark):
    left = spark.sql("SELECT * FROM VALUES ('a', date'2020-01-31'), ('a', date'2020-02-01'), ('b', date'2020-01-01') AS t(ts_code, d)")
    history = spark.sql("SELECT * FROM VALUES ('a', date'2020-01-01', date'2020-01-31', 'x'), ('a', date'2020-02-01', NULL, 'y') AS t(ts_code, effective_from, effective_to, v)")
    assert sorted((r.ts_code, str(r.d), r.v) for r in pn.interval_join(left, "d", history, ["v"]).collect()) == [("a", "2020-01-31", "x"), ("a", "2020-02-01", "y"), ("b", "2020-01-01", None)]


def test_reconcile_sees_missing_rows_nulls_and_values(spark):
    old = spark.sql("SELECT * FROM VALUES (1, 'a', 1.0D), (2, NULL, 2.0D) AS t(k, c, v)")
    new = spark.sql("SELECT * FROM VALUES (1, 'a', 1.5D), (2, 'b', 2.0D), (3, 'c', 3.0D) AS t(k, c, v)")
    r = qa.prefix_reconcile(old, new, ["k"], ["c"], ["v"], 1e-9).first()
    assert (r.missing_or_extra_rows, r.categorical_mismatches, r.maximum_numeric_error, r.status) == (1, 1, 0.5, "FAIL")
    assert qa.prefix_reconcile(old, old, ["k"], ["c"], ["v"], 1e-9).first().status == "PASS"


def test_sinks_and_fingerprints(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.lit("x"))
    src.write_parquet(df, str(tmp_path / "p"))
    src.write_report(df, str(tmp_path / "c"))
    back = src.read_csv(spark, str(tmp_path / "c"), "id long, s string")
    prints = src.table_fingerprint({"a": df, "b": back.repartition(3), "c": src.read_parquet_glob(spark, str(tmp_path / "p"))}).collect()
    assert len({(r.row_count, r.content_hash) for r in prints}) == 1
    assert fp.tree_hash(fp.file_hashes(spark, str(tmp_path / "p" / "*.parquet"))).first().files >= 1
    with pytest.raises(ValueError):
        src.require_columns(df, ["absent"])
