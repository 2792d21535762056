"""The opN_ queries: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, kneser_ney, langid, media, mixing, simhash, substrings, toxicity, warc
from .common import crc_mod, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predicted(docs, langid.trained(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.with_media(table(spark, sf_dir, "documents")))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kneser_ney.scored(table(spark, sf_dir, "documents"), ~kneser_ney.held_out())
    return found.select("doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long"), "id", role, F.lit(chat.ADDED_TEXT))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(added)
    return chat.digests(written(chat.formatted(turns), "chat"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_simhash, op3_langid, op4_webp, op5_kneser_ney, op6_substrings, op7_chat, op8_mixing, op9_toxicity, op10_decontaminate)
}
ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op6_substrings": substrings.ORACLE, "op7_chat": chat.ORACLE, "op8_mixing": mixing.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
