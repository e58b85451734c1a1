"""Typed scans of hand-made CSV files: rows that break a rule are set aside with the rules they
broke, instead of ending the job or becoming nulls.

A row is judged in one pass over its own values; keys that occur twice are counted by key and
joined back, so no task holds the rows of one key. Accepted and rejected rows come from one judged
table, and each row of the file is in exactly one of them.

Defined results: an empty field is null; a line with more or fewer fields than the header breaks
``malformed`` and no other rule; a field that its type refuses breaks ``type:<column>`` and is null
in other rules; a rule whose condition is null counts as broken; of rows with one key all break the
rule of that key; rows whose key has a null are not compared; an empty file gives two empty tables;
columns of the file that no field names are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factorloom.sources.tables import require_columns

_LINE, _RAW, _SEEN = "__line", "__raw", "__seen"


@dataclass(frozen=True)
class Contract:
    """What a file must hold. ``types``: column -> SQL type, or ``date:<format>``; ``rules``: name ->
    SQL condition on the typed columns that must be true; ``unique``: name -> key columns;
    ``required``: columns that may not be null."""

    types: Mapping[str, str]
    rules: Mapping[str, str] = field(default_factory=dict)
    unique: Mapping[str, Sequence[str]] = field(default_factory=dict)
    required: Sequence[str] = ()


def _typed(name: str, kind: str) -> Column:
    raw = F.trim(F.col(f"{_RAW}.{name}"))
    if kind.startswith("date:"):
        return F.expr(f"try_to_timestamp({_RAW}.`{name}`, '{kind[5:]}')").cast("date")
    return F.when(raw != "", raw.try_cast(kind))


def _read(spark: SparkSession, path: str, contract: Contract, sep: str, header: bool) -> DataFrame:
    """The file's rows as strings, with the line itself where its fields don't fit the columns."""
    reader = spark.read.option("header", header).option("sep", sep)
    columns = require_columns(reader.csv(path), list(contract.types)).columns if header else list(contract.types)
    schema = StructType([StructField(c, StringType()) for c in [*columns, _LINE]])
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).option("columnPruning", False).csv(path)


def judged(rows: DataFrame, contract: Contract, malformed: Column | None = None) -> DataFrame:
    """Typed columns of string rows, the strings themselves in ``raw`` and ``broken``: the rules
    that a row breaks, in the order malformed, type, required, rules, unique."""
    malformed = F.lit(False) if malformed is None else malformed
    kept = rows.select(F.struct(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in contract.types)).alias(_RAW), malformed.alias("malformed"))
    typed = kept.select(_RAW, "malformed", *(_typed(c, k).alias(c) for c, k in contract.types.items()))
    fine = ~F.col("malformed")
    broken = {"malformed": F.col("malformed")}
    broken |= {f"type:{c}": fine & F.col(f"{_RAW}.{c}").isNotNull() & F.col(c).isNull() for c, k in contract.types.items() if k != "string"}
    broken |= {f"required:{c}": fine & F.col(f"{_RAW}.{c}").isNull() for c in contract.required}
    broken |= {n: fine & ~F.coalesce(F.expr(rule), F.lit(False)) for n, rule in contract.rules.items()}
    for n, key in contract.unique.items():
        twice = typed.where(~F.col("malformed")).where(" and ".join(f"`{k}` is not null" for k in key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        typed = typed.join(twice.select(*key, F.lit(True).alias(f"{_SEEN}_{n}")), list(key), "left")
        broken[n] = fine & F.coalesce(F.col(f"{_SEEN}_{n}"), F.lit(False))
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())), lambda x: x.isNotNull())
    return typed.select(*contract.types, F.col(_RAW).alias("raw"), names.alias("broken"))


def accepted(rows: DataFrame) -> DataFrame:
    """The typed rows of a judged table that break no rule."""
    return rows.where(F.size("broken") == 0).drop("raw", "broken")


def rejected(rows: DataFrame) -> DataFrame:
    """The rows of a judged table that break rules, as they stood in the file."""
    return rows.where(F.size("broken") > 0).select("raw.*", "broken")


def read_checked_csv(spark: SparkSession, path: str, contract: Contract, sep: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with their types, and rejected rows as strings with ``broken``. Without a
    header the fields stand in the order of ``types``."""
    rows = _read(spark, path, contract, sep, header)
    out = judged(rows, contract, F.col(_LINE).isNotNull())
    return accepted(out), rejected(out)


#: The manual table of code changes: a share swap at a ratio, without cash, fees or taxes.
CORPORATE_ACTIONS = Contract(
    types={
        "old_ts_code": "string",
        "successor_ts_code": "string",
        "action_type": "string",
        "last_trade_date": "date:yyyyMMdd",
        "suspension_start_date": "date:yyyyMMdd",
        "record_date": "date:yyyyMMdd",
        "delist_date": "date:yyyyMMdd",
        "exchange_ratio": "double",
        "cash_component": "double",
        "commission_rate": "double",
        "stamp_duty_rate": "double",
        "assumption": "string",
        "source_note": "string",
    },
    rules={
        "same_code": "old_ts_code <> successor_ts_code",
        "action_type": "action_type = 'STOCK_SWAP_ABSORPTION'",
        "exchange_ratio": "exchange_ratio > 0",
        "cash_component": "cash_component = 0",
        "commission_rate": "commission_rate = 0",
        "stamp_duty_rate": "stamp_duty_rate = 0",
        "date_order": "last_trade_date < suspension_start_date and suspension_start_date <= record_date and record_date < delist_date",
    },
    unique={"repeated_action": ["old_ts_code", "delist_date"]},
    required=["old_ts_code", "successor_ts_code", "action_type", "assumption", "source_note"],
)
