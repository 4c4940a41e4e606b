"""Equality joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most: each has more than one in so many of the rows.
HOT_KEYS = 500
#: No key with fewer rows than that is broadcast.
FEW = 10_000


def join_counted(rows: DataFrame, small: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``small``, whose column ``n`` counts the rows of each key.

    Keys are unique in ``small`` and hold no nulls. Fewer than HOT_KEYS keys can have more than
    their share of the rows each, so these are broadcast and their rows stay where they are; the
    rows of all other keys are shuffled. Both sides are read more than once and should be tables.
    """
    keys = list(keys)
    total = small.agg(F.sum(n)).first()[0] or 0
    least = max(FEW, total // HOT_KEYS)
    hot = small.filter(F.col(n) > least)
    cold = rows.join(small.filter(F.col(n) <= least), keys)
    if hot.isEmpty():
        return cold
    spread = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return spread.unionByName(rest.join(small.filter(F.col(n) <= least), keys))
