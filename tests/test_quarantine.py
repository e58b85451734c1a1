"""Typed CSV scans: accepted and rejected rows."""

import datetime as dt

import pytest

from factorloom.sources.quarantine import CORPORATE_ACTIONS, Contract, read_checked_csv

GOOD = dict(old_ts_code="A", successor_ts_code="B", action_type="STOCK_SWAP_ABSORPTION", last_trade_date="20200110", suspension_start_date="20200111", record_date="20200111", delist_date="20200201", exchange_ratio="1.25", cash_component="0", commission_rate="0.0", stamp_duty_rate="0", assumption="held", source_note="note, with comma")
FAULTS = [
    ({}, None),
    ({"exchange_ratio": "abc"}, ["type:exchange_ratio", "exchange_ratio"]),
    ({"record_date": "20201340"}, ["type:record_date", "date_order"]),
    ({"record_date": ""}, ["date_order"]),
    ({"successor_ts_code": "A3"}, ["same_code"]),
    ({"action_type": "SPLIT"}, ["action_type"]),
    ({"exchange_ratio": "-1"}, ["exchange_ratio"]),
    ({"cash_component": "0.5"}, ["cash_component"]),
    ({"commission_rate": "1e-4"}, ["commission_rate"]),
    ({"stamp_duty_rate": ""}, ["stamp_duty_rate"]),
    ({"suspension_start_date": "20200110"}, ["date_order"]),
    ({"delist_date": "20200111"}, ["date_order"]),
    ({"assumption": ""}, ["required:assumption"]),
    ({"source_note": "", "action_type": ""}, ["required:action_type", "required:source_note", "action_type"]),
]


def _write(path, rows, columns, extra=()):
    quote = lambda v: f'"{v}"' if "," in v or "\n" in v else v
    path.write_text("\n".join([",".join(columns), *(",".join(quote(r[c]) for c in columns) for r in rows), *extra]) + "\n")
    return str(path)


def test_each_rule_is_hit_once_and_no_row_is_lost(spark, tmp_path):
    rows = [GOOD | {"old_ts_code": "A3" if "successor_ts_code" in f else f"C{i}"} | f for i, (f, _) in enumerate(FAULTS)]
    rows += [GOOD | {"old_ts_code": "D"}, GOOD | {"old_ts_code": "D"}]
    path = _write(tmp_path / "a.csv", rows, list(GOOD), ["A9,B,too,few", ",".join(["x"] * 14)])
    good, bad = read_checked_csv(spark, path, CORPORATE_ACTIONS)
    (kept,) = good.collect()
    assert kept.old_ts_code == "C0" and kept.delist_date == dt.date(2020, 2, 1) and kept.exchange_ratio == 1.25 and kept.source_note == "note, with comma"
    got = {}
    for r in bad.collect():
        got.setdefault(r.old_ts_code, []).append(r.broken)
    want = {rows[i]["old_ts_code"]: [b] for i, (_, b) in enumerate(FAULTS) if b}
    assert got == want | {"D": [["repeated_action"]] * 2, "A9": [["malformed"]], "x": [["malformed"]]}
    assert next(r for r in bad.collect() if r.old_ts_code == "C1").exchange_ratio == "abc"


def test_other_columns_and_order_are_free_and_missing_ones_end_the_scan(spark, tmp_path):
    columns = ["broken", *reversed(GOOD), "raw"]
    path = _write(tmp_path / "b.csv", [GOOD | {"broken": "1", "raw": "2"}], columns)
    good, bad = read_checked_csv(spark, path, CORPORATE_ACTIONS)
    assert [r.old_ts_code for r in good.collect()] == ["A"] and bad.count() == 0
    with pytest.raises(ValueError, match="record_date"):
        read_checked_csv(spark, _write(tmp_path / "c.csv", [GOOD], [c for c in GOOD if c != "record_date"]), CORPORATE_ACTIONS)


def test_empty_file(spark, tmp_path):
    good, bad = read_checked_csv(spark, _write(tmp_path / "d.csv", [], list(GOOD)), CORPORATE_ACTIONS)
    assert good.count() == 0 and bad.count() == 0 and good.columns == list(GOOD) and bad.columns == [*GOOD, "broken"]


def test_keys_with_nulls_are_not_compared(spark, tmp_path):
    c = Contract(types={"k": "string", "n": "int"}, unique={"twice": ["k"]})
    (tmp_path / "e.csv").write_text("k,n\n,1\n,2\na,3\na,x\nb,5\n")
    good, bad = read_checked_csv(spark, str(tmp_path / "e.csv"), c)
    assert sorted((r.k or "", r.n) for r in good.collect()) == [("", 1), ("", 2), ("b", 5)]
    assert sorted((r.n, tuple(r.broken)) for r in bad.collect()) == [("3", ("twice",)), ("x", ("type:n", "twice"))]
