"""Joins of intervals by a sweep in the order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundquay.operators.order import running_max


def outside(segments: DataFrame, intervals: DataFrame, by: str) -> DataFrame:
    """Segments that overlap no interval of their ``by``; both have ``start`` and ``end``.

    Two of them overlap when each starts before the other ends. So of the intervals that start
    before a segment ends, only the largest end matters: ends of segments and starts of intervals
    are put in one order, and the largest end so far is compared with the segment's start. Each row
    is taken once, however long an interval is. Segments without a time overlap nothing.
    """
    columns = segments.columns
    # at one time a segment ends before an interval starts: touching is no overlap
    ends = segments.withColumns({"_at": F.col("end").cast("double"), "_opens": F.lit(0), "_reach": F.lit(None).cast("double")})
    starts = intervals.select(
        by, F.col("start").cast("double").alias("_at"), F.lit(1).alias("_opens"), F.col("end").cast("double").alias("_reach")
    ).filter("_at is not null and _reach is not null")
    rows = ends.unionByName(starts, allowMissingColumns=True)
    swept = running_max(rows, ["_at", "_opens"], [by], "_reach", "_so_far")
    heard = F.coalesce((F.col("_so_far") > F.col("start")) & F.col("_at").isNotNull(), F.lit(False))
    return swept.filter((F.col("_opens") == 0) & ~heard).select(*columns)
