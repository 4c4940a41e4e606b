"""Queries of this package over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from soundquay.llm import (
    decontaminate,
    merkle,
    packing,
    passages,
    pii,
    quality,
    repair,
    sharding,
    simhash,
    sql,
    suffix,
    topk,
    toxicity,
    warc,
)
from soundquay.llm.tables import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_topk": op2_topk,
    "op3_pii": op3_pii,
    "op4_suffix": op4_suffix,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_repair": op11_repair,
    "op12_merkle": op12_merkle,
    "op13_passages": op13_passages,
}

SQL: dict[str, str] = {
    "op1_warc": sql.WARC,
    "op2_topk": sql.TOPK,
    "op4_suffix": sql.REPEATS,
    "op6_sharding": sql.SHARDS,
    "op11_repair": sql.REPAIR,
    "op12_merkle": sql.MERKLE,
    "op13_passages": sql.PASSAGES,
}
