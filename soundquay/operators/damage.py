"""Noise damage: metric matrix, damage index, rankings, sampling weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators.metrics import bundle


def relative_delta(x: Column, clean: Column) -> Column:
    return (x - clean) / F.greatest(clean, F.lit(fixed.BASELINE_FLOOR))


def metric_matrix(measured: DataFrame) -> DataFrame:
    """One row per (lang, subtype, level); clean audio is the row with both codes null."""
    return bundle(measured, ("lang", "noise_subtype", "noise_level"))


def languages_without_clean(matrix: DataFrame) -> DataFrame:
    return (
        matrix.groupBy("lang")
        .agg(F.max(F.col("noise_subtype").isNull().cast("int")).alias("has_clean"))
        .filter("has_clean = 0")
        .select("lang")
    )


def damage_cells(
    matrix: DataFrame,
    weights: dict[str, float] = fixed.DAMAGE_WEIGHTS,
    levels: Sequence[str] = fixed.CANONICAL_LEVELS,
) -> DataFrame:
    """Damage index of each noisy cell against the clean row of its language.

    The matrix is already aggregated (languages x subtypes x levels), so the baseline lookup is
    a window over a small table. A language without a clean row fails the job.
    """
    per_lang = Window.partitionBy("lang")
    is_clean = F.col("noise_subtype").isNull()

    def baseline(column: str) -> Column:
        return F.max(F.when(is_clean, F.col(column))).over(per_lang)

    with_clean = (
        matrix.withColumn("_has_clean", F.max(is_clean.cast("int")).over(per_lang))
        .withColumn(
            "clean_wer",
            F.when(
                F.col("_has_clean") == 0,
                F.raise_error(F.concat(F.lit("no clean row for language "), F.col("lang"))),
            ).otherwise(F.coalesce(baseline("wer"), F.lit(0.0))),
        )
        .withColumn("clean_ker", baseline("ker"))
    )
    d_wer = relative_delta(F.coalesce(F.col("wer"), F.lit(0.0)), F.col("clean_wer"))
    d_ker = F.coalesce(relative_delta(F.col("ker"), F.col("clean_ker")), F.lit(0.0))
    d_ker = F.when(F.col("ker").isNull() | F.col("clean_ker").isNull(), 0.0).otherwise(d_ker)
    score = (
        weights["wer"] * d_wer
        + weights["ker"] * d_ker
        + weights["hallucination"] * F.coalesce(F.col("hallucination_rate"), F.lit(0.0))
    )
    return with_clean.filter(~is_clean & F.col("noise_level").isin(*levels)).select(
        "lang", "noise_subtype", "noise_level", "clean_wer", F.round(score, 4).alias("ndi")
    )


def damage_ranking(cells: DataFrame) -> DataFrame:
    """Mean of the rounded cells per subtype, worst first."""
    return (
        cells.groupBy("lang", "noise_subtype")
        .agg(
            F.round(F.avg("ndi"), 4).alias("ndi"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("noise_level", "ndi")))
            ).alias("per_level"),
        )
        .orderBy(F.desc("ndi"), "lang", "noise_subtype")
    )


def top_subtypes(ranking: DataFrame, n: int = 3) -> DataFrame:
    window = Window.partitionBy("lang").orderBy(F.desc("ndi"), "noise_subtype")
    return (
        ranking.withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= n)
        .select("lang", F.col("place").cast("long").alias("place"), "noise_subtype", "ndi")
    )


def wer_grid(matrix: DataFrame, levels: Sequence[str] = fixed.CANONICAL_LEVELS) -> DataFrame:
    """Word error rate per subtype with one column per level."""
    return (
        matrix.filter(F.col("noise_subtype").isNotNull())
        .groupBy("lang", "noise_subtype")
        .pivot("noise_level", list(levels))
        .agg(F.first("wer"))
    )


def not_rising(matrix: DataFrame) -> DataFrame:
    """Subtypes measured at every level whose word error rate does not rise with the level."""
    low, mid, high = (F.col(level) for level in fixed.CANONICAL_LEVELS)
    complete = low.isNotNull() & mid.isNotNull() & high.isNotNull()
    return wer_grid(matrix).filter(complete & ~((low <= mid) & (mid <= high)))


def sampling_weights(
    damage: DataFrame,
    subtypes: DataFrame,
    residual: DataFrame,
    temperature: float = fixed.TEMPERATURE,
    boost: float = fixed.RESIDUAL_BOOST,
) -> DataFrame:
    """Softmax of damage over subtypes per language; unmitigated subtypes are boosted.

    ``damage(lang, noise_subtype, ndi)``, ``subtypes(noise_subtype)``, ``residual(noise_subtype)``;
    all three are dimension tables of at most a few hundred rows.
    """
    langs = damage.select("lang").distinct()
    flagged = residual.select("noise_subtype").distinct().withColumn("_boost", F.lit(boost))
    grid = langs.crossJoin(subtypes.select("noise_subtype").distinct())
    values = (
        grid.join(damage.select("lang", "noise_subtype", "ndi"), ["lang", "noise_subtype"], "left")
        .join(flagged, "noise_subtype", "left")
        .withColumn(
            "_z",
            F.coalesce(F.col("ndi"), F.lit(0.0))
            * F.coalesce(F.col("_boost"), F.lit(1.0))
            / max(temperature, fixed.RATIO_FLOOR),
        )
    )
    per_lang = Window.partitionBy("lang")
    weighed = values.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(per_lang)))
    return weighed.select(
        "lang", "noise_subtype", (F.col("_e") / F.sum("_e").over(per_lang)).alias("weight")
    )
