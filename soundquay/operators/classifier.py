"""Classifier quality: confusion counts, macro F1, clean recall and precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.text import family
from soundquay.operators.metrics import ratio


def confusion_counts(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, labels: Sequence[str], truth: str = "truth", pred: str = "pred"
) -> DataFrame:
    """One row per true label, one column per predicted label, zero-filled."""
    wide = df.groupBy(truth).pivot(pred, list(labels)).agg(F.count(F.lit(1)))
    return wide.na.fill(0, list(labels))


def label_scores(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of each label from confusion counts (zero-safe)."""
    named = counts.select(
        F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), "truth", "pred", "n"
    )

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    hit_truth, hit_pred = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")
    per_label = named.groupBy("label").agg(
        total(hit_truth & hit_pred).alias("tp"),
        total(~hit_truth & hit_pred).alias("fp"),
        total(hit_truth & ~hit_pred).alias("fn"),
    )
    precision = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return per_label.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1",
        F.coalesce(
            ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
            F.lit(0.0),
        ),
    )


def macro_f1(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    return label_scores(counts, labels).agg(F.avg("f1").alias("macro_f1"))


def family_counts(counts: DataFrame) -> DataFrame:
    return (
        counts.select(family(F.col("truth")).alias("truth"), family(F.col("pred")).alias("pred"), "n")
        .groupBy("truth", "pred")
        .agg(F.sum("n").alias("n"))
    )


def clean_rates(counts: DataFrame, clean: str = fixed.CLEAN) -> DataFrame:
    """Recall, false-positive rate and precision of the clean label (1 when undefined)."""
    truth, pred = F.col("truth") == clean, F.col("pred") == clean

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = counts.agg(
        total(truth & pred).alias("both"),
        total(truth).alias("is_clean"),
        total(pred).alias("says_clean"),
    )
    recall = F.coalesce(ratio(F.col("both"), F.col("is_clean")), F.lit(1.0))
    return sums.select(
        recall.alias("clean_recall"),
        (1.0 - recall).alias("clean_fp_rate"),
        F.coalesce(ratio(F.col("both"), F.col("says_clean")), F.lit(1.0)).alias("clean_precision"),
    )
