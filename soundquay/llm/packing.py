"""Optimal length buckets: dynamic programming over the global histogram of lengths.

Every document is padded to the upper bound of its bucket. The bounds are chosen over the whole
table so that the padding, summed over all documents, is as small as ``n_buckets`` buckets allow.
Inside a bucket, batches of equal padded length are filled up to a budget of tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay.llm.slots import gapless
from soundquay.llm.tables import Staged

def word_count(text: str = "text") -> Column:
    """Tokens of a text: runs of characters without white space; null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _least_costs(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j from ``first``: the least best[i] + lengths[j] * (rows of i+1..j) over i < j, and the least such i.

    The costs are Monge, so that the least i never falls when j grows: divide and conquer.
    """
    n = len(lengths)
    cost, at = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    todo = [(first, n - 1, 0, n - 1)]
    while todo:
        lo, hi, i_lo, i_hi = todo.pop()
        if lo > hi:
            continue
        j = (lo + hi) // 2
        stop = min(j - 1, i_hi) + 1
        tried = best[i_lo:stop] + lengths[j] * (rows[j + 1] - rows[i_lo + 1 : stop + 1])
        k = int(np.argmin(tried))
        cost[j], at[j] = tried[k], i_lo + k
        todo += [(lo, j - 1, i_lo, i_lo + k), (j + 1, hi, i_lo + k, i_hi)]
    return cost, at


def bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding; of equal ones, the smaller bounds.

    best[j] is the least sum of padded lengths for the lengths up to j; a bucket i+1..j pads the
    documents in it to lengths[j].
    """
    lengths, rows = np.asarray(lengths, np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    n = len(lengths)
    k = min(n_buckets, n)
    if not n:
        return []
    best = lengths * rows[1:]
    back = np.full((k, n), -1)
    for b in range(1, k):
        cost, at = _least_costs(best, lengths, rows, b)
        better = cost < best
        back[b, better] = at[better]
        best = np.where(better, cost, best)
    out, j = [], n - 1
    for b in range(k - 1, -1, -1):
        if b == 0 or back[b, j] < 0:
            if b == 0:
                out.append(int(lengths[j]))
            continue
        out.append(int(lengths[j]))
        j = int(back[b, j])
    return out[::-1]


def pack(
    docs: DataFrame, n_buckets: int = 16, budget: int = 8192, length: Column | None = None
) -> DataFrame:
    """Place every row in a bucket and a batch.

    Returns doc_id, n_tokens, bucket (from 0, by length), padded_tokens (the bucket's bound), batch
    (from 0 inside the bucket), place (inside the batch) and batch_rows (rows a full batch holds).
    A batch holds budget // padded_tokens rows, at least one: a text longer than the budget is a
    batch of its own and stays whole. Texts of no tokens count one for padding. Rows of a bucket
    are ordered by a hash of doc_id and length. No rows give no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (word_count() if length is None else length).alias("n_tokens"),
    )
    rows = rows.withColumn("cell", F.greatest(F.col("n_tokens"), F.lit(1)).cast("long"))
    rows = rows.withColumn("order", F.md5(F.concat_ws(":", F.lit("pack"), F.col("doc_id"), F.col("n_tokens"))))
    staged = Staged(docs.sparkSession, "packing").keep(rows, "lengths")
    # distinct lengths only: d of them take d * d / 2 tokens of text at least
    cells = staged.groupBy("cell").count().toPandas().sort_values("cell")
    edges = bounds(cells["cell"].to_numpy(np.int64), cells["count"].to_numpy(np.int64), n_buckets)
    bucket, padded = F.lit(0), F.lit(1)
    for i, edge in reversed(list(enumerate(edges))):
        inside = F.col("cell") <= edge
        bucket = F.when(inside, i).otherwise(bucket)
        padded = F.when(inside, edge).otherwise(padded)
    placed = staged.withColumns(
        {"bucket": bucket.cast("int"), "padded_tokens": padded.cast("long")}
    )
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_tokens"))).cast("long")
    return gapless(placed, ["bucket"], "order").select(
        "doc_id", "n_tokens", "bucket", "padded_tokens",
        F.floor(F.col("slot") / fits).cast("long").alias("batch"),
        F.pmod(F.col("slot"), fits).cast("long").alias("place"),
        fits.alias("batch_rows"),
    )
