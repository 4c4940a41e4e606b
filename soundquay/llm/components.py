"""Connected components of a link table, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundquay.llm.tables import Staged


def components(links: DataFrame, work: Staged) -> DataFrame:
    """Columns node and root for every node of ``links`` (a, b: longs); root is the least node.

    Each round links the larger neighbours of a node to its least neighbour (large star), then the
    smaller ones (small star); rounds follow the logarithm of the number of nodes, also for long
    chains. A round is written to the shared folder and replaces the one before. Least neighbours
    are pre-aggregated, and the joins on a node may be split by Spark where one node has many
    links. Repeated links and self links do no harm.
    """
    now, path = work.put(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large, large_path = work.put(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct("u", F.col("m").alias("v")),
            )).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        old = path
        now, path = work.put(small, "small")
        work.drop(old)
        work.drop(large_path)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
