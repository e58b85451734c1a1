"""Partitions by the input's size, and bars dealt once by their code."""

import re

import duckdb
import pytest

from factorloom.plans import panels as pl
from factorloom.sources import tables as src
from factorloom.sources.bindings import BINDINGS, bars_of

SF = "/root/testdata/sf0.001"


def test_partitions_grow_with_the_bytes(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert src.parts_for(spark, ((1, 10, 0), None)) == least
    assert src.parts_for(spark, ((1, 100 * src.PART_BYTES, 0), None, (2, 1, 0))) == 101


def test_buckets_and_first_partitions_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(src, "PART_BYTES", 16384)
    monkeypatch.setattr(pl, "_PANELS", type(pl._PANELS)())
    p = pl.panels(spark, SF)
    n = src.parts_for(spark, src.file_state(spark, [f"{SF}/{t}.parquet" for t in pl.GROWING]))
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.conf.get(src.INITIAL) == str(n)
    assert p["b_daily"].rdd.getNumPartitions() <= n and f"{n} out of {n}" in p["b_daily"].groupBy("ts_code").count()._jdf.queryExecution().executedPlan().toString()
    p.discard()
    monkeypatch.undo()
    pl.panels(spark, SF)
    assert spark.conf.get(src.INITIAL) == spark.conf.get("spark.sql.shuffle.partitions")


def test_bars_are_those_of_the_text_with_one_exchange(spark):
    got = bars_of(spark.read.parquet(f"{SF}/lineitem.parquet"), 4)
    assert len(re.findall(r"Exchange hashpartitioning", got._jdf.queryExecution().executedPlan().toString())) == 1
    con = duckdb.connect()
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({BINDINGS['b_daily'].replace('FROM lineitem', f"FROM '{SF}/lineitem.parquet'")}) ORDER BY ts_code, trade_date").fetchall()
    rows = [tuple(r) for r in got.orderBy("ts_code", "trade_date").collect()]
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert all(a == pytest.approx(b, rel=1e-12) for r, w in zip(rows, want, strict=True) for a, b in zip(r[3:], w[3:], strict=True))
