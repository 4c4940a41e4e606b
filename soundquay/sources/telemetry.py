"""Telemetry files: JSON lines, one folder per UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundquay import schemas
from soundquay.operators.operations import telemetry_lines


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append lines under their UTC day. The session time zone is expected to be UTC."""
    lines = telemetry_lines(df).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    lines.write.mode(mode).partitionBy("day").json(path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """All days; broken lines and lines without a total latency are left out."""
    df = (
        spark.read.schema(schemas.TELEMETRY).option("mode", "DROPMALFORMED").json(path)
    )
    return df.filter(F.col("latency_ms.total").isNotNull())
