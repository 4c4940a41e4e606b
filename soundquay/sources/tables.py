"""Operational tables: upsert, append with ids, run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundquay.operators.order import latest_by_key, number_rows


def upsert(
    current: DataFrame, changes: DataFrame, key: Sequence[str], sequence: str
) -> DataFrame:
    """Insert or replace by primary key; among several changes of a key the last one wins."""
    last = latest_by_key(changes, key, [sequence]).drop(sequence)
    kept = current.join(last.select(*key), list(key), "left_anti")
    return kept.unionByName(last.select(*current.columns))


def append_with_ids(current: DataFrame, rows: DataFrame, order: Sequence[str], id_name: str = "id"):
    """Append rows with the next ids in ``order``."""
    top = current.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("_top"))
    numbered = number_rows(rows, order, (), "_at").crossJoin(F.broadcast(top))  # one row
    new = numbered.withColumn(id_name, (F.col("_top") + F.col("_at") + 1).cast("long"))
    return current.unionByName(new.select(*current.columns))


#: One report for each run, as it is written and read back.
REPORT = (
    "run_id string, model_version string, dataset_id string, created_at string, seed bigint, "
    "metrics map<string, struct<wer: double, cer: double, ker: double, hallucination_rate: double, "
    "n_utts: bigint, n_keywords: bigint>>"
)


def write_report(metrics: DataFrame, path: str, run_id: str, model_version: str, dataset_id: str, seed: int) -> None:
    """Append the report of a run as one JSON document; rates that were not measured stay out."""
    known = [c for c in ("wer", "cer", "ker", "hallucination_rate", "n_utts", "n_keywords") if c in metrics.columns]
    # one row per language
    by_lang = metrics.agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct(*known)))).alias("metrics"))
    by_lang.select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_version).alias("model_version"),
        F.lit(dataset_id).alias("dataset_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lit(seed).cast("long").alias("seed"),
        "metrics",
    ).write.mode("append").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def append_run(metrics: DataFrame, path: str, run_id: str, model_version: str, dataset_id: str):
    """Append one run to the log: the per-language rates as a JSON document."""
    rates = [c for c in metrics.columns if c != "lang"]
    document = metrics.agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct("lang", F.struct(*rates))))
        ).alias("metrics_json")
    )
    document.select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_version).alias("model_version"),
        F.lit(dataset_id).alias("dataset_id"),
        "metrics_json",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    ).write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
