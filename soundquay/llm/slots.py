"""Numbering without gaps inside groups of any size, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_CELL = 20_000


def gapless(df: DataFrame, groups: list[str], order: str, out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 in the order of ``order``, a lower-case hex digest.

    Rows of a group are dealt into cells by the leading hex digits of the digest, so that a cell
    holds about ROWS_PER_CELL rows however large its group is. A cell is sorted by itself and
    starts where the cells before it end. The number of cells follows the number of rows; the
    result does not depend on it. Rows with the same digest share a cell in any order. ``groups``
    hold no nulls. ``df`` is read twice and should be a table.
    """
    digits, cells = 2, 256
    n = df.count()
    while n / cells > ROWS_PER_CELL and digits < 8:
        digits, cells = digits + 1, cells * 16
    placed = df.withColumn("_cell", F.substring(order, 1, digits))
    keys = [*groups, "_cell"]
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy("_cell")
    starts = (
        placed.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .withColumn(
            "_start",
            F.coalesce(F.sum("_rows").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_rows")
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return (
        placed.join(starts, keys)
        .withColumn(out, (F.col("_start") + inside - 1).cast("long"))
        .drop("_cell", "_start")
    )
