"""Manifests: typed read, noise bank, merge of a new batch, summary sidecar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundquay import schemas


def fold_nan(df: DataFrame) -> DataFrame:
    """Files written from data frames carry NaN where a number is missing."""
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """Utterances with the fixed schema; a missing keyword list reads as an empty one."""
    df = fold_nan(spark.read.schema(schemas.MANIFEST).parquet(*paths))
    return df.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_noise_bank(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Clips, optionally of one split: only the folders of that split are listed and read."""
    df = spark.read.schema(schemas.NOISE_BANK).parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def write_noise_bank(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by split and subtype: every reader wants one split, and most one subtype."""
    df.repartition("split", "subtype").write.mode(mode).partitionBy("split", "subtype").parquet(path)


def merge_batch(old: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace all old rows whose key value occurs in the new batch."""
    kept = old.join(batch.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(batch)


def concat_fragments(spark: SparkSession, *paths: str) -> DataFrame:
    """The fragments that separate stages have written, as one table."""
    return spark.read.parquet(*paths)


def summary(manifest: DataFrame) -> DataFrame:
    """The one-row dataset summary: rows, languages, clean and mixed counts, hours."""
    clean = F.col("noise_subtype").isNull()
    return manifest.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array_sort(F.collect_set("lang")).alias("langs"),
        F.sum(clean.cast("long")).alias("n_clean"),
        F.sum((~clean).cast("long")).alias("n_mixed"),
        (F.sum("duration_s") / 3600.0).alias("hours"),
    )


def write_summary(manifest: DataFrame, path: str) -> None:
    summary(manifest).write.mode("overwrite").json(path)
