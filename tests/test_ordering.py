"""Exact quantiles and ranks by buckets against numpy and plain ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import ordering


@pytest.fixture(scope="module")
def values():
    rng = random.Random(2)
    out = []
    for g in "abcde":
        n = {"a": 1, "b": 2, "c": 500, "d": 3000, "e": 7}[g]
        for _ in range(n):
            out.append((g, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), rng.choice([0.0, 1.0, -1.0, 2.5]), 10 ** rng.uniform(-300, 300), -(10 ** rng.uniform(-20, 3))])))
    out += [("c", None), ("f", None), ("c", 5e-324), ("c", -5e-324), ("c", -0.0), ("c", 1.7e308)]
    return out


def test_quantiles_equal_linear_interpolation(spark, values):
    df = spark.createDataFrame(values, "g string, x double").withColumn("k", F.col("x") * 0.5)
    got = {r.g: r for r in ordering.quantiles(df, ["g"], {"x": F.col("x"), "k": F.col("k")}, {"p01": 0.01, "p50": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    assert set(got) == set("abcde")
    for g, r in got.items():
        x = np.array([v for h, v in values if h == g and v is not None])
        for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99), ("top", 1.0)):
            for of, scale in (("x", 1.0), ("k", 0.5)):
                assert r[f"{of}_{n}"] == pytest.approx(np.quantile(x * scale, q), rel=1e-12, abs=1e-310)


def test_average_ranks_with_ties(spark, values):
    df = spark.createDataFrame(values, "g string, x double")
    got = {(r.g, r.value): (r.average_rank, r.n, r.total) for r in ordering.average_ranks(df, ["g"], F.col("x")).collect()}
    for g in "abcde":
        x = sorted(v for h, v in values if h == g and v is not None)
        for v in set(x):
            below, same = sum(y < v for y in x), sum(y == v for y in x)
            assert got[g, v] == (below + (same + 1) / 2, same, len(x))


def test_buckets_never_fall(spark):
    x = sorted([*(s * 2.0**e * m for s in (-1, 1) for e in range(-1074, 1024, 7) for m in (1.0, 1.0000001, 1.5, 1.9999999)), 0.0, float("inf"), float("-inf")])
    b = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", ordering.radix(F.col("x")).alias("b")).orderBy("i").collect()]
    assert b == sorted(b)


def test_no_window_holds_a_group(spark, values):
    df = spark.createDataFrame(values, "g string, x double")
    plan = ordering.average_ranks(df, ["g"], F.col("x"))._jdf.queryExecution().optimizedPlan().toString()
    over_values = [line for line in plan.splitlines() if "Window" in line and "value#" in line.split("windowspecdefinition", 1)[-1]]
    assert over_values and all("__bucket" in line for line in over_values)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert ordering.quantiles(df, ["g"], {"x": F.col("x")}, {"p": 0.5}).collect() == [] and ordering.average_ranks(df, ["g"], F.col("x")).collect() == []
