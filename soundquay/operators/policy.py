"""Mitigation policy: chain effectiveness, policy table, effectiveness report, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators.metrics import bundle


def relative_gain(base: Column, other: Column) -> Column:
    return (base - other) / F.greatest(base, F.lit(fixed.RATIO_FLOOR))


def chain_effectiveness(measured: DataFrame) -> DataFrame:
    """Rates and mean latency per (lang, subtype, level, chain); clean rows keep a null level."""
    keys = ["lang", "subtype", "level", "chain"]
    latency = F.avg("latency_ms").alias("latency_ms")
    rates = bundle(measured, keys, [latency])
    return rates.select(*keys, "wer", "ker", F.col("n_utts").alias("n"), "latency_ms")


def delta_against_none(effect: DataFrame) -> DataFrame:
    """Word error rate against the untouched audio of the same cell (null level = clean cell)."""
    cell = Window.partitionBy("lang", "subtype", "level")
    plain = F.max(F.when(F.col("chain") == fixed.NO_CHAIN, F.col("wer"))).over(cell)
    return effect.withColumn("d_wer_vs_none", F.col("wer") - plain)


def _known(column: str) -> Column:
    """Mean over the values that are there: NaN from files counts as missing."""
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def chain_scores(
    effect: DataFrame,
    latency_budget_ms: float = fixed.LATENCY_BUDGET_MS,
    min_gain: float = fixed.MIN_REL_IMPROVEMENT,
) -> DataFrame:
    """Per (subtype, chain): the worst language's gain and whether every language allows it.

    ``effect`` is aggregated down to (lang, subtype, chain) first, so the steps after the first
    ``groupBy`` run over a table of a few thousand rows whatever the input size.
    """
    means = effect.groupBy("lang", "subtype", "chain").agg(
        _known("wer").alias("wer"),
        _known("ker").alias("ker"),
        _known("latency_ms").alias("latency_ms"),
        F.min("chain_order").alias("chain_order") if "chain_order" in effect.columns
        else F.first("chain").alias("chain_order"),
    )
    n_langs = means.select(F.countDistinct("lang").alias("n_langs"))
    cell = Window.partitionBy("lang", "subtype")
    is_none = F.col("chain") == fixed.NO_CHAIN

    def none_value(column: str) -> Column:
        return F.max(F.when(is_none, F.col(column))).over(cell)

    judged = (
        means.withColumn("_none_wer", none_value("wer"))
        .withColumn("_none_ker", none_value("ker"))
        .withColumn("_has_none", F.max(is_none.cast("int")).over(cell) == 1)
        .withColumn("rel", relative_gain(F.col("_none_wer"), F.col("wer")))
        .filter(~is_none)
    )
    worse_ker = F.coalesce(F.col("ker") > F.col("_none_ker") + fixed.KER_EPS, F.lit(False))
    slow = F.coalesce(F.col("latency_ms") > latency_budget_ms, F.lit(False))
    # an unknown gain is not below the limit, but it never wins either
    too_small = F.coalesce(F.col("rel") < min_gain, F.lit(False))
    allowed = F.col("_has_none") & ~worse_ker & ~slow & ~too_small
    return (
        judged.withColumn("_allowed", allowed)
        .groupBy("subtype", "chain")
        .agg(
            F.bool_and("_allowed").alias("_all_allowed"),
            F.count(F.lit(1)).alias("_n"),
            F.count("rel").alias("_n_rel"),
            F.min("rel").alias("worst_gain"),
            F.min("chain_order").alias("chain_order"),
        )
        .crossJoin(F.broadcast(n_langs))  # one row
        .select(
            "subtype",
            "chain",
            "chain_order",
            "worst_gain",
            (
                F.col("_all_allowed")
                & (F.col("_n") == F.col("n_langs"))
                & (F.col("_n_rel") == F.col("n_langs"))
            ).alias("allowed"),
        )
    )


def generate_policy(
    effect: DataFrame,
    subtypes: DataFrame,
    latency_budget_ms: float = fixed.LATENCY_BUDGET_MS,
    min_gain: float = fixed.MIN_REL_IMPROVEMENT,
) -> DataFrame:
    """Best allowed chain per subtype, ``none`` where no chain is allowed or nothing was measured.

    Ties go to the chain with the lowest ``chain_order`` (input order) when that column is given,
    else to the first by name.
    """
    best = Window.partitionBy("subtype").orderBy(F.desc("worst_gain"), "chain_order")
    chosen = (
        chain_scores(effect, latency_budget_ms, min_gain)
        .filter("allowed")
        .withColumn("_place", F.row_number().over(best))
        .filter("_place = 1")
        .select("subtype", "chain")
    )
    wanted = (
        subtypes.select("subtype")
        .unionByName(effect.select("subtype"))
        .distinct()
        .filter(F.col("subtype") != fixed.CLEAN_KEY)
    )
    return wanted.join(chosen, "subtype", "left").select(
        "subtype", F.coalesce("chain", F.lit(fixed.NO_CHAIN)).alias("chain")
    )


def residual_subtypes(subtypes: DataFrame, policy: DataFrame | None) -> DataFrame:
    """Subtypes that no chain helps; all of them when there is no policy yet."""
    wanted = subtypes.select("subtype").distinct()
    if policy is None:
        return wanted
    helped = policy.filter(F.col("chain") != fixed.NO_CHAIN).select("subtype")
    return wanted.join(helped, "subtype", "left_anti")


def effectiveness_report(effect: DataFrame, policy: DataFrame) -> DataFrame:
    """Chosen chain per subtype with its worst-language gain and slowest mean latency."""
    means = effect.groupBy("lang", "subtype", "chain").agg(
        F.avg("wer").alias("wer"), F.avg("latency_ms").alias("latency_ms")
    )
    plain = means.filter(F.col("chain") == fixed.NO_CHAIN).select(
        "lang", "subtype", F.col("wer").alias("none_wer")
    )
    chosen = (
        means.join(policy, ["subtype", "chain"])
        .filter(F.col("chain") != fixed.NO_CHAIN)
        .join(plain, ["lang", "subtype"], "left")
    )
    measured = chosen.groupBy("subtype").agg(
        F.min(relative_gain(F.col("none_wer"), F.col("wer"))).alias("worst_gain"),
        F.max("latency_ms").alias("latency_ms"),
    )
    return policy.join(measured, "subtype", "left").select(
        "subtype",
        "chain",
        "worst_gain",
        "latency_ms",
        (F.col("chain") == fixed.NO_CHAIN).alias("residual"),
    )


def clean_harm(effect: DataFrame, limit: float = fixed.CLEAN_HARM) -> DataFrame:
    """What each chain does to clean audio; a gain below ``limit`` is flagged."""
    clean = effect.filter(F.col("subtype") == fixed.CLEAN_KEY)
    means = clean.groupBy("lang", "chain").agg(F.avg("wer").alias("wer"))
    per_lang = Window.partitionBy("lang")
    plain = F.max(F.when(F.col("chain") == fixed.NO_CHAIN, F.col("wer"))).over(per_lang)
    gain = relative_gain(F.col("none_wer"), F.col("wer"))
    return (
        means.withColumn("none_wer", plain)
        .filter(F.col("chain") != fixed.NO_CHAIN)
        .select(
            "lang", "chain", "none_wer", "wer", gain.alias("gain"), (gain < limit).alias("harms")
        )
    )


def apply_policy(df: DataFrame, policy: DataFrame, mode: str, predicted: str = "noise_pred"):
    """Look up the chain of the predicted subtype.

    ``off`` predicts nothing, ``log_only`` looks up but applies nothing, ``active`` applies.
    """
    if mode == "off":
        return (
            df.withColumn(predicted, F.lit(None).cast("string"))
            .withColumn("chain", F.lit(fixed.NO_CHAIN))
            .withColumn("chain_applied", F.array().cast("array<string>"))
        )
    table = policy.select(F.col("subtype").alias(predicted), F.col("chain").alias("_chain"))
    chain = F.coalesce(F.col("_chain"), F.lit(fixed.NO_CHAIN))
    active = (F.lit(mode) == "active") & (chain != fixed.NO_CHAIN)
    return (
        df.join(table, predicted, "left")
        .withColumn("chain", chain)
        .withColumn(
            "chain_applied",
            F.when(active, F.array("chain")).otherwise(F.array().cast("array<string>")),
        )
        .drop("_chain")
    )
