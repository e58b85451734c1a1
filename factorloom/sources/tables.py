"""Scans, sinks, inventories and fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FractionalType, StructField, StructType, TimestampNTZType, TimestampType


def scan_union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Parts of one dataset put together by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(pattern)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with header, typed by the schema or all strings."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if schema else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Only in local
    mode a temporary folder takes its place where the setting is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def hand_over(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a step's result to the shared folder, or the given one in it, and read it back: later
    steps start from the table, and the loss of an executor costs no earlier step."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


#: With it a join on more columns than the buckets' uses the buckets of both sides as they are.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def hand_over_bucketed(df: DataFrame, name: str, folder: str, column: str, n: int, dealt: bool = False) -> tuple[DataFrame, str]:
    """``hand_over`` as a table in n buckets of a column, one file each, and the table's name: windows
    within the column's values and joins on it with alike tables need no exchange. Bucket and
    shuffle use one hash, so the write takes a single exchange, or none of a frame that is ``dealt`` to n
    partitions of the column; the column's values must be many, as a bucket holds all rows of a value."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = (df if dealt else df.repartition(n, column)).write.mode("overwrite").option("compression", "zstd").option("path", f"{folder}/{table}")
    writer.bucketBy(n, column).saveAsTable(table)
    return spark.table(table), table


#: Partitions before adaptive execution puts small ones together.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PART_BYTES = 8 << 20


def parts_for(spark: SparkSession, state: tuple) -> int:
    """Partitions for inputs of a ``file_state``: by their bytes, so that what a task sorts does not
    grow with the input, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(s[1] for s in state if s) // PART_BYTES))


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def file_state(spark: SparkSession, paths: list[str]) -> tuple:
    """For each path (a file or a folder of files) how many files, bytes and which latest change;
    nothing for one that is absent."""
    out = []
    for path in paths:
        system, where = _hadoop(spark, path)
        if not system.exists(where):
            out.append(None)
            continue
        files = [f for f in system.listStatus(where) if not f.isDirectory()]
        out.append((len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)))
    return tuple(out)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of tables that nothing reads any more."""
    if spark._jsc is not None and not spark._jsc.sc().isStopped():
        system, where = _hadoop(spark, path)
        system.delete(where, True)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result table as CSV with header, or as JSON lines."""
    df.write.mode("overwrite").format(kind).option("header", True).save(path)


def input_inventory(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and date range of each dataset, PASS if it has rows."""
    rows = []
    for name, (df, day) in tables.items():
        date = F.col(day).cast("date") if day else F.lit(None).cast("date")
        rows.append(df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("minimum_date"), F.max(date).alias("maximum_date")).select(F.lit(name).alias("dataset"), "*"))
    return scan_union_by_name(rows).withColumn("status", F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL"))


def _field_text(field: StructField) -> Column:
    """One text for each value of a column, the same in other engines: numbers with a fraction
    as whole millionths, times to the microsecond."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    millionths = lambda x: F.floor(x.cast("double") * 1_000_000).cast("string")
    if isinstance(kind, ArrayType):
        return F.concat_ws(",", F.transform(c, millionths))
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return millionths(c) if isinstance(kind, FractionalType) else c.cast("string")


def table_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and a content hash that does not depend on their order: the sums of the first two
    32-bit parts of each row's MD5, as decimals, which neither overflow nor wrap."""
    rows = []
    for name, df in tables.items():
        row = F.md5(F.concat_ws("|", *(F.when(F.col(f"`{f.name}`").isNull(), "-").otherwise(F.md5(_field_text(f))) for f in df.schema.fields)).cast("binary"))
        parts = [F.coalesce(F.sum(F.conv(F.substr("h", F.lit(at), F.lit(8)), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 9)]
        rows.append(df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *parts).alias("content_hash")).select(F.lit(name).alias("table"), "*"))
    return scan_union_by_name(rows)
