"""Small tables of constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(value):
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def constant_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A handful of constant rows as an expression: no Python worker, no shuffle, known size."""
    fields = [part.strip().split(" ", 1) for part in schema.split(", ")]
    structs = [
        F.struct(
            *[
                _literal(value).cast(kind).alias(name)
                for value, (name, kind) in zip(row, fields, strict=True)
            ]
        )
        for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))
