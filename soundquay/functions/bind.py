"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    A plain expression used inside an array lambda is evaluated again for every element (also
    when it was given a column name before: projections are merged). A lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
