"""Corpus preparation: quality rules, toxicity, near duplicates, repeated passages, packing.

Defined results of the stages: a null or empty text fails the quality rules; documents of any
length go through whole; repeated rows share each verdict, and as they have one doc_id they stay
together in the near-duplicate stage and are packed each; rows without doc_id are not compared
with others; an empty table gives an empty result, and models without usable labels keep what
the base rules keep; further columns, whatever their names, stay up to the last stage; without a
column n_chars none is made. Ties: of linked documents the least doc_id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import packing, quality, similarity, substring, toxicity
from factorloom.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that count as toxic go. The model learns from labelled documents of this
    stage's input, without those held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep_ordinary(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    return similarity.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier go; n_chars, where there is one, follows the text."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack)]

#: SQL cannot express the trained stages and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
