"""Exact search for the largest inner products by a table of pivot distances.

Vectors become points of a Euclidean space with one more coordinate, sqrt(M^2 - |x|^2) for the
rows and 0 for the queries (M: the largest norm), where a larger inner product is a smaller
distance. Distances of all rows to many pivots make a table; by the triangle inequality
|d(q, p) - d(x, p)| is a lower bound of d(q, x) for each pivot p, and the greatest one counts.

Rows are dealt into blocks around their nearest pivot, with the range of distances to every pivot.
A first round searches the most promising block of each query and gives it a score to beat; a
second round sends the query to the other blocks whose bound can beat it. Inside a block, queries
near the same pivot go together: rows whose bounds rule them out for all of these are left out, and
the scores of the others are one matrix product. Vectors travel in the narrowest integer type that
holds all components, without their line of the table, which a task works out again sooner than it
could be moved. Bounds are floats with a margin for rounding; scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundquay.llm.tables import Staged

PIVOTS = 48
#: Rows and queries that meet in one task at most (blocks of rows, groups of queries).
BLOCK_ROWS = 2048
GROUP_QUERIES = 4096
#: Queries whose bounds and scores are computed at once.
_QUERIES_AT_ONCE = 256
#: Blocks of rows with their queries that a task searches one after another, about.
_BLOCKS_A_TASK = 4
_FOUND = "query_id long, vec_id long, score long"
#: A score to beat where there is none.
_NONE = np.iinfo(np.int64).min


def whole(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as longs; null for null, missing or non-finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a common width; shorter vectors count as followed by zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < pc.list_value_length(vectors).to_numpy()[:, None]] = vectors.flatten().to_numpy()
    return out


def _lists(table: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    kind = pa.list_(pa.from_numpy_dtype(table.dtype))
    return pa.FixedSizeListArray.from_arrays(table.ravel(), table.shape[1]).cast(kind)


def _exact(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest type in which the inner products of q and x are exact."""
    most = np.prod([np.abs(m.astype(np.float64)).max(initial=0) for m in (q, x)]) * q.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class Space:
    """The points and the pivots; small enough to travel with the tasks."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.width, self.reach = pivots.shape[1], reach
        self.pivots = pivots.astype(np.float64)
        self.last = np.sqrt(np.maximum(reach - (self.pivots**2).sum(1), 0.0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return self._to_pivots(x, np.sqrt(np.maximum(self.reach - (x**2).sum(1), 0.0)))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self._to_pivots(q.astype(np.float64), np.zeros(len(q)))

    def _to_pivots(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        gap = x @ self.pivots.T + last[:, None] * self.last[None, :]
        size = (x**2).sum(1) + last**2
        return np.sqrt(np.maximum(size[:, None] + (self.pivots**2).sum(1) + self.last**2 - 2 * gap, 0.0))

    def most(self, q_size, lower) -> np.ndarray:
        """The largest score that a lower bound of the distance leaves possible."""
        lower = np.maximum(lower - 1e-5 * (1 + np.sqrt(self.reach + q_size)), 0.0)
        return (q_size + self.reach - lower**2) / 2 + 1e-6 * (1 + self.reach + q_size)


def _search(space: Space, k: int):
    """Search one block of rows for one group of queries; ``floor`` is a score to beat or to equal."""

    def of(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 3]
        if len(queries) and len(rows):
            rows = rows.sort_by("vec_id")
            x, ids = _matrix(rows["v"], space.width), rows["vec_id"].to_numpy()
            asked = _matrix(queries["v"], space.width)
            far, far_rows = space.queries(asked), space.rows(x).T.astype(np.float32, order="C")
            order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
            asked, far = asked[order], far[order].astype(np.float32)
            who = queries["query_id"].to_numpy()[order]
            floors = pc.fill_null(queries["floor"], _NONE).to_numpy()[order]
            sizes = (asked.astype(np.float64) ** 2).sum(1)
            kind = _exact(asked, x)
            asked, x = asked.astype(kind), x.astype(kind)
            for at in range(0, len(asked), _QUERIES_AT_ONCE):
                some = slice(at, at + _QUERIES_AT_ONCE)
                least, most = far[some].min(axis=0)[:, None], far[some].max(axis=0)[:, None]
                lower = np.maximum(least - far_rows, far_rows - most).max(axis=0)
                near = space.most(sizes[some].max(), lower) >= floors[some].min()
                near = slice(None) if near.all() else np.flatnonzero(near)
                i, j, scores = _best(asked[some] @ x[near].T, who[some], ids[near], floors[some], k)
                out.append([who[some][i], ids[near][j], scores.astype(np.int64)])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return of


def _best(scores: np.ndarray, who: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int):
    """Places and values of the k best scores of each query (row) that reach its floor, without rows
    of its own id. ids ascend; of equal scores the first count."""
    own = np.searchsorted(ids, who), np.searchsorted(ids, who, "right")
    for i in np.flatnonzero(own[0] < own[1]):
        scores[i, own[0][i] : own[1][i]] = -np.inf
    floors = floors.astype(scores.dtype)
    free = np.flatnonzero(floors == _NONE)
    if len(free) and len(ids) > k:
        floors[free] = np.maximum(floors[free], np.partition(scores[free], -k, axis=1)[:, -k])
    good = scores >= floors[:, None]
    i, j = np.divmod(np.flatnonzero(good), max(1, len(ids)))
    many = np.flatnonzero(np.bincount(i, minlength=len(who)) > k)
    if len(many):
        some = scores[many]
        kth = np.partition(some, -k, axis=1)[:, [-k]]
        above, equal = some > kth, some == kth
        good[many] = above | (equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
        i, j = np.divmod(np.flatnonzero(good), len(ids))
    return i, j, scores[i, j]


def _route(space: Space, ranges: list[tuple[np.ndarray, np.ndarray]]):
    """For each query the largest score that each block may hold."""

    @F.arrow_udf("array<double>")
    def of(vectors: pa.Array) -> pa.Array:
        q = _matrix(vectors, space.width)
        d, sizes = space.queries(q), (q.astype(np.float64) ** 2).sum(1)
        most = [space.most(sizes, np.maximum(lo - d, d - hi).max(axis=1)) for lo, hi in ranges]
        return _lists(np.stack(most, axis=1))

    return of


def largest_products(
    rows: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products of each query.

    ``rows`` has vec_id and v (array of longs), ``queries`` query_id and v; null vectors take no
    part. A query never meets a row of its own id. Ties go to the smaller vec_id; a repeated row
    counts each time. Queries with fewer than k rows get all of them, without rows none.
    """
    work = Staged(rows.sparkSession, "topk")
    rows = work.keep(rows.filter("v is not null and vec_id is not null").select("vec_id", "v"), "rows")
    queries = work.keep(queries.filter("v is not null and query_id is not null").select("query_id", "v"), "queries")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    least, most = F.coalesce(F.min(F.array_min("v")), F.lit(0)), F.coalesce(F.max(F.array_max("v")), F.lit(0))
    facts, asking = (
        side.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), least.alias("least"), most.alias("most"),
                 F.max(size).alias("size")).first()
        for side in (rows, queries)
    )
    if not facts["n"] or not asking["n"]:
        return work.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(facts["width"], asking["width"], 1)
    narrow = f"array<{_narrowest(min(facts['least'], asking['least']), max(facts['most'], asking['most']))}>"
    #: distinct vectors, since copies of a pivot bound nothing more
    spread = rows.select(F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(pivots)
    chosen = rows.join(F.broadcast(spread), F.xxhash64("v") == F.col("h")).dropDuplicates(["h"]).orderBy("h").select("v").toArrow()
    space = Space(_matrix(chosen["v"], width), float(facts["size"]))

    @F.arrow_udf("array<float>")
    def far(vectors: pa.Array) -> pa.Array:
        return _lists(space.rows(_matrix(vectors, width)).astype(np.float32))

    nearest = F.array_position("far", F.array_min("far")).cast("int") - 1
    table = rows.select("vec_id", F.col("v").cast(narrow).alias("v"), far("v").alias("far"))
    table = work.keep(table.withColumn("block", nearest), "pivot-table")
    ranges = [F.array(*[of(F.get("far", F.lit(j))) for j in range(len(chosen))]) for of in (F.min, F.max)]
    near = table.groupBy("block").agg(F.count("*"), *ranges).orderBy("block").collect()
    cuts = {block: -(-n // BLOCK_ROWS) for block, n, _, _ in near}
    route = _route(space, [(np.array(lo), np.array(hi)) for _, _, lo, hi in near])
    asked = queries.select("query_id", F.col("v").cast(narrow).alias("v"), route("v").alias("route"))
    best = F.array_position("route", F.array_max("route")).cast("int") - 1
    numbers = F.array(*[F.lit(block) for block in cuts])
    asked = work.keep(asked.withColumn("best", F.get(numbers, best)), "routes")

    def round_(sent: DataFrame, groups: dict[int, int]) -> DataFrame:
        """Search the blocks that queries are sent to; ``groups`` counts the groups of queries by block."""
        keys = ["block", "cut", "part"]
        of_block = {
            name: F.create_map(*[F.lit(y) for x in counts.items() for y in x])[F.col("block")]
            for name, counts in (("cuts", cuts), ("groups", groups))
        }
        sent = sent.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(2)), of_block["groups"]).cast("int"))
        sent = sent.withColumn("cut", F.explode(F.sequence(F.lit(0), of_block["cuts"] - 1)))
        dealt = table.select(
            "vec_id", "v", "block", F.pmod(F.xxhash64("vec_id", F.lit(1)), of_block["cuts"]).cast("int").alias("cut"),
            F.explode(F.sequence(F.lit(0), of_block["groups"] - 1)).alias("part"),
        )
        #: the work of a task is far from its bytes, by which Spark would merge partitions
        meetings = sum(cuts[block] * n for block, n in groups.items())
        least = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = min(meetings, max(least, meetings // _BLOCKS_A_TASK))
        sent, dealt = (side.repartition(tasks, *keys).groupBy(*keys) for side in (sent, dealt))
        return sent.cogroup(dealt).applyInArrow(_search(space, k), _FOUND)

    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best_first).cast("int")).filter(F.col("rank") <= k)

    homes = asked.groupBy(F.col("best").alias("block")).count().collect()
    first = asked.select("query_id", "v", F.col("best").alias("block"), F.lit(None).cast("long").alias("floor"))
    seeds = work.keep(round_(first, {block: -(-n // GROUP_QUERIES) for block, n in homes}), "seeds")
    floors = ranked(seeds).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
    sent = (
        asked.join(floors, "query_id", "left")
        .select("query_id", "v", "best", "floor", F.posexplode("route").alias("place", "most"))
        .withColumn("block", F.get(numbers, F.col("place")))
        .filter("block <> best and (floor is null or most >= floor)")
        .select("query_id", "v", "block", "floor")
    )
    groups = -(-asking["n"] // GROUP_QUERIES)
    found = round_(sent, dict.fromkeys(cuts, groups)).unionByName(seeds)
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def _narrowest(least: int, most: int) -> str:
    """The smallest integer type of Spark that holds values from ``least`` to ``most``."""
    fits = (kind for kind, bits in (("smallint", 15), ("int", 31)) if -(2**bits) <= least and most < 2**bits)
    return next(fits, "bigint")


def report(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Search with the rows whose vec_id is divisible by ``every``, against all rows."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v"))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return largest_products(rows, queries, k)
