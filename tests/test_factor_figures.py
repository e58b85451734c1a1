"""The factor panel's steps: only a month's figures are written and joined, and only the bars' columns
that factors read are made."""

from factorloom.operators import factors
from factorloom.plans.panels import Panels

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    columns = [*factors.KEY, "universe_eligible", "liquidity_20pct_cutoff", *(f"{f}{x}" for f in factors.FACTORS for x in ("_p01", "_p99"))]
    scores = [f"{f}_z" for f in factors.FACTORS]
    exact, near = columns, scores
    rows = df.select(*exact, *near).orderBy(*factors.KEY).collect()
    return [(*r[: len(exact)], *(x if x is None else round(x, 9) for x in r[len(exact) :])) for r in rows]


def test_scores_write_a_months_figures_and_shuffle_no_row(spark, tmp_path):
    p, kept = Panels(spark, SF), {}

    def keep(df, name):
        kept[name] = p._keep(df, name)
        return kept[name]

    got = factors.scored(p.raw, keep=keep)
    months = p.raw.select("signal_date").distinct().count()
    assert set(kept) == {"cutoffs", "limits", "moments"} and all(x.count() <= months for x in kept.values())
    assert "Exchange hashpartitioning" not in _plan(got) and "SortMergeJoin" not in _plan(got)
    assert _rows(got) == _rows(factors.scored(p.raw))
    p.discard()


def test_factors_do_not_write_the_daily_panel(spark):
    p = Panels(spark, SF)
    got = _rows(p.factor_panel)
    assert "daily" not in p.__dict__
    assert "hashpartitioning(ts_code" not in _plan(p.day_rows().groupBy("ts_code", "trade_date").count())
    assert p.entity_bars.where(f"not coalesce({factors.VALID_BAR}, false)").count() == 0
    assert got and got == _rows(factors.factor_panel(p.monthly, p.daily))
    assert p.day_rows() is p.daily
    p.discard()
