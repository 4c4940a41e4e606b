"""Data-contract and leakage checks. Each returns the violating rows; no rows means healthy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed


def _broken(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in pairs]))


def _with_reasons(df: DataFrame, key: str, *pairs: tuple[Column, str]) -> DataFrame:
    return df.select(key, _broken(*pairs).alias("reasons")).filter(F.size("reasons") > 0)


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """Required fields and allowed values of the dataset manifest."""
    return _with_reasons(
        manifest,
        "utterance_id",
        (_blank("utterance_id"), "utterance_id"),
        (_blank("text"), "text"),
        (F.coalesce(~F.col("lang").isin(*fixed.LANGS), F.lit(True)), "lang"),
        (F.coalesce(F.isnan("duration_s") | (F.col("duration_s") <= 0), F.lit(True)), "duration_s"),
        (_blank("source"), "source"),
    )


def noise_bank_rows(bank: DataFrame, subtypes: Sequence[str] = fixed.SUBTYPES) -> DataFrame:
    return _with_reasons(
        bank,
        "clip_id",
        (F.coalesce(F.col("duration_s") < fixed.MIN_CLIP_S, F.lit(True)), "duration_s"),
        (_blank("license"), "license"),
        (F.coalesce(~F.col("split").isin(*fixed.SPLITS), F.lit(True)), "split"),
        (F.coalesce(~F.col("subtype").isin(*subtypes), F.lit(True)), "subtype"),
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def leaked_recordings(bank: DataFrame) -> DataFrame:
    """Recordings that stand in more than one split."""
    return (
        bank.groupBy("recording_id")
        .agg(F.min("split").alias("_first"), F.max("split").alias("_last"))
        .filter("_first <> _last")
        .select("recording_id")
    )


def thin_subtypes(
    bank: DataFrame,
    min_train: int = fixed.MIN_TRAIN_CLIPS,
    min_eval: int = fixed.MIN_EVAL_CLIPS,
) -> DataFrame:
    """Subtypes with too few clips in a split."""

    def count(split: str) -> Column:
        return F.sum((F.col("split") == split).cast("long"))

    return (
        bank.groupBy("subtype")
        .agg(count("train").alias("n_train"), count("eval").alias("n_eval"))
        .filter((F.col("n_train") < min_train) | (F.col("n_eval") < min_eval))
    )


def incomplete_cells(
    manifest: DataFrame, subtypes: DataFrame, levels: DataFrame, expected: int | None = None
) -> DataFrame:
    """Grid cells (and the clean cell) whose row count is not the expected one.

    Without ``expected`` the clean row count of the language is expected in every cell.
    """
    counts = manifest.groupBy("lang", "noise_subtype", "noise_level").agg(
        F.count(F.lit(1)).alias("n")
    )
    langs = manifest.select("lang").distinct()
    cells = langs.crossJoin(  # languages x subtypes x levels: a fixed small grid
        subtypes.select("noise_subtype").crossJoin(levels.select("noise_level"))
    ).unionByName(
        langs.select(
            "lang",
            F.lit(None).cast("string").alias("noise_subtype"),
            F.lit(None).cast("string").alias("noise_level"),
        )
    )
    clean = counts.filter("noise_subtype is null").select("lang", F.col("n").alias("clean_n"))
    same = (
        (cells["lang"] == counts["lang"])
        & cells["noise_subtype"].eqNullSafe(counts["noise_subtype"])
        & cells["noise_level"].eqNullSafe(counts["noise_level"])
    )
    filled = cells.join(counts, same, "left").select(
        cells["lang"],
        cells["noise_subtype"],
        cells["noise_level"],
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    wanted = F.lit(expected) if expected is not None else F.coalesce("clean_n", F.lit(0))
    return (
        filled.join(clean, "lang", "left")
        .withColumn("expected", wanted.cast("long"))
        .filter(F.col("n") != F.col("expected"))
        .drop("clean_n")
    )


def off_target_snr(manifest: DataFrame, tolerance: float = fixed.SNR_TOLERANCE_DB) -> DataFrame:
    """Mixes that miss their target level; silent mixes (infinite ratio) are exempt."""
    off = F.abs(F.col("snr_db_achieved") - F.col("snr_db_target"))
    return manifest.filter((off > tolerance) & (off != float("inf")))


def eval_clips_in_training(train: DataFrame, bank: DataFrame) -> DataFrame:
    eval_clips = bank.filter(F.col("split") == "eval").select(
        F.col("clip_id").alias("noise_clip_id")
    )
    return train.select("utterance_id", "noise_clip_id").join(
        eval_clips, "noise_clip_id", "left_semi"
    )


def training_mix(
    train: DataFrame,
    share: float = fixed.CLEAN_SHARE,
    slack: float = fixed.CLEAN_SHARE_SLACK,
) -> DataFrame:
    """One row: the share of clean rows, rows outside every level band, and the verdict."""
    inside = F.lit(False)
    for low, high in fixed.SNR_BANDS_DB.values():
        inside = inside | F.col("snr_db_target").between(low, high)
    summary = train.agg(
        F.avg(F.col("noise_subtype").isNull().cast("double")).alias("clean_share"),
        F.sum((F.col("noise_subtype").isNotNull() & ~inside).cast("long")).alias("n_off_band"),
    )
    return summary.withColumn(
        "ok",
        (F.abs(F.col("clean_share") - share) <= slack + 1e-9) & (F.col("n_off_band") == 0),
    )


def uncovered_targets(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keyword targets that no utterance carries."""
    covered = manifest.select("lang", F.explode("keywords").alias("target"))
    return targets.select("lang", "target").join(covered, ["lang", "target"], "left_anti")
