"""Promotion gates: base against candidate, with the reasons of every refusal as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators.policy import relative_gain


def relative_regression(base: Column, candidate: Column) -> Column:
    return (candidate - base) / F.greatest(base, F.lit(fixed.RATIO_FLOOR))


def _sides(base: DataFrame, candidate: DataFrame, columns: list[str]) -> DataFrame:
    left = base.select("lang", *[F.col(c).alias(f"base_{c}") for c in columns])
    right = candidate.select("lang", *[F.col(c).alias(f"cand_{c}") for c in columns])
    return left.join(right, "lang")


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in pairs]))


def promotion_decision(
    base: DataFrame,
    candidate: DataFrame,
    min_noisy_gain: float = fixed.MIN_NOISY_IMPROVEMENT,
    max_clean_regression: float = fixed.MAX_CLEAN_REGRESSION,
    max_recall_drop: float = fixed.MAX_RECALL_DROP,
) -> DataFrame:
    """Per language: noisy gain, clean regression, recall drop, verdict and reasons."""
    both = _sides(base, candidate, ["noisy_wer", "clean_wer", "keyword_recall"])
    scored = (
        both.withColumn(
            "noisy_gain", relative_gain(F.col("base_noisy_wer"), F.col("cand_noisy_wer"))
        )
        .withColumn(
            "clean_regression",
            relative_regression(F.col("base_clean_wer"), F.col("cand_clean_wer")),
        )
        .withColumn("recall_drop", F.col("base_keyword_recall") - F.col("cand_keyword_recall"))
    )
    reasons = _reasons(
        (~(F.col("noisy_gain") >= min_noisy_gain), "noisy_gain"),
        (~(F.col("clean_regression") <= max_clean_regression), "clean_regression"),
        (~(F.col("recall_drop") <= max_recall_drop), "recall_drop"),
    )
    return scored.select(
        "lang",
        F.round("noisy_gain", 4).alias("noisy_gain"),
        F.round("clean_regression", 4).alias("clean_regression"),
        F.round("recall_drop", 4).alias("recall_drop"),
        reasons.alias("reasons"),
        (F.size(reasons) == 0).alias("passed"),
    )


def regression_decision(
    base: DataFrame,
    candidate: DataFrame,
    max_recall_drop: float = fixed.MAX_RECALL_DROP,
    max_generic_regression: float = fixed.MAX_GENERIC_REGRESSION,
) -> DataFrame:
    """Against forgetting: keyword recall and generic word error rate per language."""
    both = _sides(base, candidate, ["keyword_recall", "generic_wer"])
    scored = both.withColumn(
        "recall_drop", F.col("base_keyword_recall") - F.col("cand_keyword_recall")
    ).withColumn(
        "generic_regression",
        relative_regression(F.col("base_generic_wer"), F.col("cand_generic_wer")),
    )
    reasons = _reasons(
        (~(F.col("recall_drop") <= max_recall_drop), "recall_drop"),
        (~(F.col("generic_regression") <= max_generic_regression), "generic_regression"),
    )
    return scored.select(
        "lang",
        F.round("recall_drop", 4).alias("recall_drop"),
        F.round("generic_regression", 4).alias("generic_regression"),
        reasons.alias("reasons"),
        (F.size(reasons) == 0).alias("passed"),
    )


def overall(decision: DataFrame) -> DataFrame:
    """Promote only when every language passes."""
    return decision.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("promote"),
        F.array_sort(
            F.flatten(
                F.collect_list(
                    F.transform("reasons", lambda r: F.concat_ws(": ", F.col("lang"), r))
                )
            )
        ).alias("reasons"),
    )


def shadow_gate(
    shadow: DataFrame,
    regression_ok: Column | bool = True,
    latency_budget_ms: float = fixed.REQUEST_BUDGET_MS,
) -> DataFrame:
    """Decision on shadow metrics; each failing condition alone blocks the promotion."""
    ok = regression_ok if isinstance(regression_ok, Column) else F.lit(regression_ok)
    latency = (
        F.coalesce(F.col("cand_latency_ms"), F.lit(0.0))
        if "cand_latency_ms" in shadow.columns
        else F.lit(0.0)
    )
    reasons = _reasons(
        (F.col("cand_wer") > F.col("prod_wer"), "wer"),
        (F.col("cand_logprob") < F.col("prod_logprob") - fixed.MAX_LOGPROB_WORSE, "logprob"),
        (latency > latency_budget_ms, "latency"),
        (~ok, "regression"),
    )
    return shadow.withColumn("reasons", reasons).withColumn("promote", F.size("reasons") == 0)
