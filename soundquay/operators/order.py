"""Numbering and running totals over a total order, without one task seeing all rows.

``row_number() over (order by ...)`` or over a handful of partitions puts a whole table (or a
whole language, subtype, ...) on one task. Here Spark's own range partitioning deals the rows out in
order, with a hash of the row as the last key, so that a value that many rows share is split as
well. The dealt rows are written once; the counts of the partitions are accumulated, and the rank
inside a partition plus what lies before it is the rank in the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundquay.sources.stage import stage_table


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    within: Sequence[str] = (),
    position: str = "position",
    value: Column | None = None,
    before: str = "before",
    buckets: int | None = None,
) -> DataFrame:
    """Add the zero-based ``position`` in ``order`` (inside ``within``).

    With ``value`` also add ``before``, the sum of ``value`` over the earlier rows. Rows with equal
    order keys follow a hash of the row. ``buckets`` is the number of range partitions (None: as
    many as Spark's shuffles have); it steers how evenly rows spread and never the numbers.
    """
    within = list(within)
    group = F.to_json(F.struct(*within)) if within else F.lit("")
    hashable = [name for name, kind in df.dtypes if "map<" not in kind]
    keyed = df.withColumn("_tie", F.xxhash64(*hashable)).withColumn("_group", group)
    keyed = keyed.withColumn("_amount", value if value is not None else F.lit(0))
    ranges = ["_group", *order, "_tie"]
    dealt = keyed.repartitionByRange(buckets, *ranges) if buckets else keyed.repartitionByRange(*ranges)
    placed = stage_table(dealt.withColumn("_bucket", F.spark_partition_id()), "numbered")
    earlier = (
        Window.partitionBy("_group")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per group and partition
    offsets = (
        placed.groupBy("_group", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_total"))
        .select(
            "_group",
            "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset_total"),
        )
    )
    local = Window.partitionBy("_group", "_bucket").orderBy(*order, "_tie")
    running = local.rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(offsets, ["_group", "_bucket"]).withColumn("_local", F.row_number().over(local) - 1)
    out = [*df.columns, (F.col("_offset") + F.col("_local")).cast("long").alias(position)]
    if value is not None:
        ranked = ranked.withColumn(
            "_local_total", F.coalesce(F.sum("_amount").over(running), F.lit(0))
        )
        out.append((F.col("_offset_total") + F.col("_local_total")).alias(before))
    return ranked.select(*out)


def running_max(
    df: DataFrame, order: Sequence[str], within: Sequence[str], value: str, out: str = "so_far"
) -> DataFrame:
    """Add ``out``, the largest ``value`` of the earlier rows in ``order`` (null: none), inside ``within``.

    Rows are dealt in order as for ``number_rows``: the largest value of each partition is carried
    over to the partitions behind it, so a group may hold any share of the rows.
    """
    within = list(within)
    hashable = [name for name, kind in df.dtypes if "map<" not in kind]
    keyed = df.withColumn("_tie", F.xxhash64(*hashable)).withColumn("_group", F.to_json(F.struct(*within)))
    dealt = keyed.repartitionByRange("_group", *order, "_tie")
    placed = stage_table(dealt.withColumn("_bucket", F.spark_partition_id()), "swept")
    behind = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("_group", "_bucket").agg(F.max(value).alias("_top")).select(
        "_group", "_bucket", F.max("_top").over(behind).alias("_carried")
    )
    local = Window.partitionBy("_group", "_bucket").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(carried, ["_group", "_bucket"])
    return joined.select(*df.columns, F.greatest("_carried", F.max(value).over(local)).alias(out))


def values_at_shares(
    df: DataFrame, value: str, shares: dict[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """The sorted value at index ``min(n - 1, floor(share * n))`` for each named share.

    Rows are counted per distinct value first (combined on the map side); only the distinct values
    are put in order, with the counts before them.
    """
    within = list(within)
    counted = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_rows"))
    ordered = stage_table(
        number_rows(counted, [value], within, "_at", F.col("_rows"), "_before"), "shares"
    )
    sizes = ordered.groupBy(*within).agg(F.sum("_rows").alias("_count"))
    if within:
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in within]
        keyed = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in within], "_count")
        match = same[0]
        for more in same[1:]:
            match = match & more
        together = ordered.join(keyed, match)
    else:
        together = ordered.crossJoin(F.broadcast(sizes))  # one row: a global count
    picks = []
    for name, share in shares.items():
        index = F.least(F.col("_count") - 1, F.floor(F.lit(share) * F.col("_count")))
        inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_rows"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return together.groupBy(*within).agg(F.max("_count").cast("long").alias("n"), *picks)


def latest_by_key(df: DataFrame, key: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Last write per key. A max over a struct combines on the map side, so a hot key is cheap."""
    rest = [c for c in df.columns if c not in key and c not in sequence]
    picked = df.groupBy(*key).agg(F.max(F.struct(*sequence, *rest)).alias("_last"))
    return picked.select(
        *[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in df.columns]
    )


def first_k(
    df: DataFrame, within: Sequence[str], order: Sequence[Column | str], k: int | Column
) -> DataFrame:
    """The first ``k`` rows of each group; Spark drops surplus rows before the shuffle."""
    window = Window.partitionBy(*within).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")
    )
