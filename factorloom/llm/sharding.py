"""Proportional stratified interleaving of documents into shards, in DataFrame operations only.

Rows are ranked by a seeded hash within their source, ordered by fractional rank
``(rank - 0.5) / rows of the source`` and cut into equal runs, so that every shard holds each
source in proportion. No window holds a whole source or the whole table: ranks are taken
within hash buckets and shifted by the rows of the buckets before.

Defined results: a null text counts 8 bytes and has the crc of the empty text; a null source
is a stratum of its own; equal rows are kept and get neighbouring or other slots; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs into which hashes and fractional ranks are cut for ranking: a run of ten thousand
#: million rows then has ten million.
RANK_BUCKETS = 1024


def _bucket_starts(counts: DataFrame, bucket: str, within: list[str]) -> DataFrame:
    """For each bucket its first position and the rows in all buckets; counts has a row for
    each bucket, so the window is over at most RANK_BUCKETS rows of a stratum."""
    over = Window.partitionBy(*within) if within else Window.partitionBy()
    return counts.select(
        *within,
        bucket,
        (F.sum("rows_here").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows_here")).alias("rows_before"),
        F.sum("rows_here").over(over).alias("rows_all"),
    )


def _fractional(rows: DataFrame) -> DataFrame:
    """Adds the fractional rank of each row within its stratum."""
    starts = _bucket_starts(rows.groupBy("stratum", "hash_bucket").agg(F.count(F.lit(1)).alias("rows_here")), "hash_bucket", ["stratum"])
    ranked = rows.withColumn("rank_here", F.row_number().over(Window.partitionBy("stratum", "hash_bucket").orderBy("shuffled", "doc_id")))
    rank = F.col("rows_before") + F.col("rank_here")
    return (
        ranked.join(starts, ["stratum", "hash_bucket"])
        .withColumn("fraction", (rank - F.lit(0.5)) / F.col("rows_all"))
        .withColumn("run", F.floor(F.col("fraction") * RANK_BUCKETS).cast("int"))
        .drop("rows_before", "rows_all", "rank_here")
    )


def stratified_shards(docs: DataFrame, shards: int = 24, seed: int = 42, size: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Assign each row of docs(doc_id, text, source) to a shard and a gapless slot in it.

    Counts of shards differ by one row at most. ``keep`` names columns (or expressions by
    alias) of docs to carry along besides doc_id.
    """
    keep = keep or []
    base = docs.select(
        "doc_id",
        *keep,
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("shuffled"),
    ).withColumn("hash_bucket", F.shiftrightunsigned(F.col("shuffled"), 54).cast("int"))
    rows = _fractional(base)
    # The counts need no more than ids and sources; the scan for them is pruned to these.
    light = _fractional(base.select("doc_id", "stratum", "shuffled", "hash_bucket"))
    runs = _bucket_starts(light.groupBy("run").agg(F.count(F.lit(1)).alias("rows_here")), "run", [])
    place = Window.partitionBy("run").orderBy("fraction", "stratum", "shuffled", "doc_id")
    return (
        rows.withColumn("here", F.row_number().over(place))
        .join(F.broadcast(runs), "run")  # at most RANK_BUCKETS rows
        .withColumn("position", F.col("rows_before") + F.col("here") - 1)
        .withColumn("shard", F.floor(F.col("position") * shards / F.col("rows_all")).cast("int"))
        .withColumn("slot", F.col("position") - F.ceil(F.col("shard") * F.col("rows_all") / shards))
        .select("doc_id", *keep, "shard", "slot")
    )


def op6_stratified_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return stratified_shards(sized, keep=["size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
