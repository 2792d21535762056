"""The corpus pipeline: documents through five operators, each stage written and read again.

Each row is a document. Rows that share a doc_id, or have none, stay apart: stages that look at
more than one row join by a row's file and place in it, which nothing but another file changes.
Null and empty texts are not toxic, are near-duplicates of each other, lose no words, contain no
benchmark item and have size 0 in the mixture, which leaves them out where their source has no
words. Stages take empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import decontaminate, mixing, simhash, substrings, toxicity
from lakewright.llm.common import keyed, remove, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on their labels, does not call toxic."""
    machine = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(COLUMNS), machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id (null: the last), then the least hash of its columns, then the first in the files."""
    docs = keyed(docs.select(COLUMNS), "row", "pipeline-rows")
    found = simhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row")
    least = found.join(docs.select("row", order.alias("order")), "row").groupBy("component_id").agg(F.min("order").alias("least"))
    return docs.join(least.select(F.col("least.row").alias("row")), "row", "left_semi").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier (null ids first); texts that lose none stay as they are."""
    docs = keyed(docs.select(COLUMNS), "row", "pipeline-rows")
    cut = substrings.deduplicated(docs.select("row", "doc_id", "text"), "row").filter("n_removed > 0").select("row", "kept")
    joined = docs.join(cut, "row", "left")
    text = F.when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("kept").isNotNull(), F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contained(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to target weights; repeated ones differ in copy."""
    return mixing.emitted(docs.select(COLUMNS))


STAGES = [("toxicity", reject_toxic), ("near duplicates", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("mixing", mix)]
#: A factorization machine is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        remove(spark, before)  # what an earlier stage wrote; never the table itself
    return docs
