"""Registered queries: checked input, intervals and order statistics of large groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions import ordering
from factorloom.operators import intervals
from factorloom.plans.panels import Panels
from factorloom.plans.registry import plan
from factorloom.sources import fingerprints
from factorloom.sources.quarantine import CORPORATE_ACTIONS, read_checked_csv
from factorloom.sources.tables import shared_folder

#: Faults of the derived action file by c_custkey % 16: what stands in a column instead, in SQL, and
#: the rules that it breaks.
FAULTS = {
    1: ({}, "malformed"),
    2: ({"exchange_ratio": "'abc'"}, "type:exchange_ratio,exchange_ratio"),
    3: ({"successor_ts_code": "concat('C', c_custkey)"}, "same_code"),
    4: ({"action_type": "'SPLIT'"}, "action_type"),
    5: ({"exchange_ratio": "'0'"}, "exchange_ratio"),
    6: ({"cash_component": "'1.5'"}, "cash_component"),
    7: ({"commission_rate": "'0.001'"}, "commission_rate"),
    8: ({"stamp_duty_rate": "'0.0005'"}, "stamp_duty_rate"),
    9: ({"record_date": "'19980101'"}, "date_order"),
    10: ({}, "repeated_action"),
    11: ({"source_note": "''"}, "required:source_note"),
    12: ({"delist_date": "'19981399'"}, "type:delist_date,date_order"),
}
_START = "1998-01-10"
_FIELDS = {
    "old_ts_code": "concat('C', c_custkey)",
    "successor_ts_code": "concat('N', c_custkey)",
    "action_type": "'STOCK_SWAP_ABSORPTION'",
    "last_trade_date": "19980110",
    "suspension_start_date": "19980112",
    "record_date": "19980112",
    "delist_date": "19980201",
    "exchange_ratio": "cast(1 + (c_custkey % 8) / 8.0 as decimal(6, 3))",
    "cash_component": "'0'",
    "commission_rate": "'0.0'",
    "stamp_duty_rate": "'0'",
    "assumption": "'held through the swap'",
    "source_note": "concat('notice ', c_custkey)",
}


def _field(name: str) -> str:
    """A field of the file as text, in SQL of both engines."""
    cases = " ".join(f"when {k} then {f[name]}" for k, (f, _) in FAULTS.items() if name in f)
    plain = f"cast({_FIELDS[name]} as varchar(40))"
    return f"case c_custkey % 16 {cases} else {plain} end" if cases else plain


def _action_file(p: Panels) -> str:
    """A file of manual actions derived from the customers, faults included; lines with fault 1
    have a field too many, those with fault 10 stand twice."""

    def make() -> str:
        path = f"{shared_folder(p.spark)}/actions-{uuid.uuid4().hex}"
        fields = [F.expr(_field(c)) for c in CORPORATE_ACTIONS.types]
        kind = F.col("c_custkey") % 16
        line = F.concat(F.concat_ws(",", *fields), F.when(kind == 1, ",more").otherwise(""))
        p["customer"].select(F.explode(F.when(kind == 10, F.array(line, line)).otherwise(F.array(line)))).write.text(path)
        return path

    return p.made("action_file", make)


def _actions(p: Panels) -> tuple[DataFrame, DataFrame]:
    return read_checked_csv(p.spark, _action_file(p), CORPORATE_ACTIONS, header=False)


_dates = [c for c, k in CORPORATE_ACTIONS.types.items() if k.startswith("date")]
_numbers = [c for c, k in CORPORATE_ACTIONS.types.items() if k == "double"]
_typed = ", ".join(f"strptime({c}, '%Y%m%d')::DATE AS {c}" if c in _dates else f"{c}::DOUBLE AS {c}" if c in _numbers else c for c in CORPORATE_ACTIONS.types)
_text = ", ".join(f"{_field(c)} AS {c}" for c in _FIELDS)
plan("action_input_accepted", lambda p: _actions(p)[0], f"SELECT {_typed} FROM (SELECT {_text} FROM customer WHERE c_custkey % 16 NOT IN ({', '.join(map(str, FAULTS))}))", " ".join(_numbers))
_broken = " ".join(f"WHEN {k} THEN '{rules}'" for k, (_, rules) in FAULTS.items())
plan(
    "action_input_rejected",
    lambda p: _actions(p)[1].select("old_ts_code", "exchange_ratio", "delist_date", F.array_join("broken", ",").alias("broken")),
    f"SELECT old_ts_code, exchange_ratio, delist_date, broken FROM (SELECT {_text}, CASE c_custkey % 16 {_broken} END AS broken, unnest(range(CASE WHEN c_custkey % 16 = 10 THEN 2 ELSE 1 END)) FROM customer) WHERE broken IS NOT NULL",
)


plan(
    "action_input_rules",
    lambda p: _actions(p)[1].select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows")),
    f"""SELECT rule, count(*) AS rows FROM (SELECT unnest(string_split(CASE c_custkey % 16 {_broken} END, ',')) AS rule FROM
      (SELECT c_custkey, unnest(range(CASE WHEN c_custkey % 16 = 10 THEN 2 ELSE 1 END)) AS copy FROM customer WHERE c_custkey % 16 IN ({', '.join(map(str, FAULTS))}))) GROUP BY rule""",
)


def _spans(p: Panels) -> DataFrame:
    """Intervals of unequal length from the orders; every 17th is open, every 19th reversed."""
    days = F.when(F.col("o_orderkey") % 19 == 0, -3).otherwise(F.col("o_orderkey") % 97).cast("int")
    start = F.col("o_orderdate").cast("date")
    return p["orders"].select(F.col("o_orderpriority").alias("ts_code"), start.alias("effective_from"), F.when(F.col("o_orderkey") % 17 != 0, F.date_add(start, days)).alias("effective_to"))


_span_sql = "SELECT o_orderkey AS k, o_orderpriority AS ts_code, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE + CASE WHEN o_orderkey % 19 = 0 THEN -3 ELSE o_orderkey % 97 END::INT ELSE DATE '9999-12-31' END AS b FROM orders"
plan(
    "interval_overlap_pairs",
    lambda p: intervals.overlapping_pairs(_spans(p), ["ts_code"]),
    f"""SELECT ts_code, intervals, coalesce(pairs, 0) AS overlapping_pairs FROM (SELECT ts_code, count(*) AS intervals FROM ({_span_sql}) WHERE b >= a GROUP BY ts_code) LEFT JOIN
      (SELECT x.ts_code, count(*) AS pairs FROM ({_span_sql}) x JOIN ({_span_sql}) y ON x.ts_code = y.ts_code AND x.k < y.k AND x.a <= y.b AND y.a <= x.b WHERE x.b >= x.a AND y.b >= y.a GROUP BY x.ts_code) USING (ts_code)""",
)


def _names(p: Panels) -> DataFrame:
    """Names of which those of every third supplier stay valid 45 days too long."""
    longer = F.when(F.substr("ts_code", F.lit(1), F.lit(6)).cast("int") % 3 == 0, F.date_add("effective_to", 45)).otherwise(F.col("effective_to"))
    return p["b_name_history"].withColumn("effective_to", longer)


_names_sql = "SELECT ts_code, stock_name, effective_from AS a, coalesce(CASE WHEN substr(ts_code, 1, 6)::INT % 3 = 0 THEN effective_to + 45 ELSE effective_to END, DATE '9999-12-31') AS b FROM b_name_history"
plan(
    "interval_matches",
    lambda p: intervals.matches_of(p["b_daily"].select("ts_code", "trade_date"), "trade_date", _names(p), ["stock_name"]),
    f"SELECT d.ts_code, d.trade_date, arg_max(n.stock_name, n.b) AS stock_name, count(n.a) AS matches FROM b_daily d LEFT JOIN ({_names_sql}) n ON n.ts_code = d.ts_code AND d.trade_date BETWEEN n.a AND n.b GROUP BY d.ts_code, d.trade_date",
)


def _match_counts(p: Panels) -> DataFrame:
    """What the observation of a look-up saw, as a row; reading the look-up is the only pass."""
    rows, seen = intervals.single_match(p["b_daily"].select("ts_code", "trade_date"), "trade_date", _names(p), ["stock_name"])
    rows.write.format("noop").mode("overwrite").save()
    return p.spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in seen.get.items()))


plan(
    "interval_match_counts",
    _match_counts,
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE n = 0) AS unmatched, count(*) FILTER (WHERE n > 1) AS ambiguous FROM (
      SELECT count(x.a) AS n FROM b_daily d LEFT JOIN ({_names_sql}) x ON x.ts_code = d.ts_code AND d.trade_date BETWEEN x.a AND x.b GROUP BY d.ts_code, d.trade_date)""",
)

_flags = ["l_returnflag", "l_linestatus"]
_probabilities = {"p01": 0.01, "p20": 0.2, "p50": 0.5, "p99": 0.99}
_measures = ["l_extendedprice", "l_quantity"]
_q = [f"{m}_{n}" for m in _measures for n in _probabilities]
plan(
    "group_quantiles",
    lambda p: ordering.quantiles(p["lineitem"], _flags, {m: F.col(m) for m in _measures}, _probabilities),
    f"SELECT {', '.join(_flags)}, {', '.join(f'quantile_cont({m}, {q}) AS {m}_{n}' for m in _measures for n, q in _probabilities.items())} FROM lineitem GROUP BY ALL",
    " ".join(_q),
    6,
)
plan(
    "group_average_ranks",
    lambda p: ordering.average_ranks(p["lineitem"], _flags, F.col("l_quantity")),
    f"SELECT {', '.join(_flags)}, value, n, before, total, before + (n + 1) / 2.0 AS average_rank FROM (SELECT *, sum(n) OVER w - n AS before, sum(n) OVER (PARTITION BY {', '.join(_flags)}) AS total FROM (SELECT {', '.join(_flags)}, l_quantity::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY {', '.join(_flags)} ORDER BY value))",
    "value average_rank",
)

plan("dataset_files", lambda p: fingerprints.dataset_files({"lineitem": (p["lineitem"], "l_shipdate"), "orders": (p["orders"], "o_orderdate"), "events": (p["events"], "ts"), "supplier": (p["supplier"], None), "documents": (p["documents"], None)}))


def _file_lists(p: Panels) -> tuple[DataFrame, DataFrame]:
    """A list of files derived from the parts, and a later one: every 5th is changed, every 7th
    gone, every 11th new."""
    n = F.col("p_partkey")
    own = p["part"].select(n, F.concat(F.lit("raw/"), n).alias("path"), F.col("p_size").cast("long").alias("size_bytes"), F.sha2("p_name", 256).alias("sha256"))
    before = own.where(n % 11 != 0)
    after = own.where(n % 7 != 0).withColumn("sha256", F.when(n % 5 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")))
    return before.drop("p_partkey"), after.drop("p_partkey")


_own = "SELECT p_partkey AS n, 'raw/' || p_partkey AS path, p_size::BIGINT AS size_bytes, sha256(p_name) AS h FROM part"
_lists = f"(SELECT * FROM ({_own}) WHERE n % 11 <> 0) a FULL JOIN (SELECT n, path, size_bytes, CASE WHEN n % 5 = 0 THEN sha256(path) ELSE h END AS h FROM ({_own}) WHERE n % 7 <> 0) b"
_compared = f"SELECT path, a.size_bytes AS size_before, a.h AS sha256_before, b.size_bytes AS size_after, b.h AS sha256_after, CASE WHEN a.h IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'REMOVED' WHEN a.h = b.h AND a.size_bytes = b.size_bytes THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM {_lists} USING (path)"
plan("compare_files", lambda p: fingerprints.compare_files(*_file_lists(p)), _compared)
_each = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("UNCHANGED", "CHANGED", "ADDED", "REMOVED"))
plan(
    "protected_inputs",
    lambda p: fingerprints.protected_inputs(*_file_lists(p)),
    f"SELECT *, CASE WHEN unchanged = greatest(files_before, files_after) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(sha256_before) AS files_before, count(sha256_after) AS files_after, {_each} FROM ({_compared}))",
)
