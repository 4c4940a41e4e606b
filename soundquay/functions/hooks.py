"""Seam for user code that scores rows in batches (recogniser, denoiser, remote judge)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_with(
    df: DataFrame,
    make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
    columns: list[str],
) -> DataFrame:
    """Run a batch function over ``columns``.

    ``make_scorer`` is called once per partition, so a model is loaded once, not per row; only
    the named columns travel to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield scorer(batch)

    return df.select(*columns).mapInPandas(run, schema)
