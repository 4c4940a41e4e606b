"""Labelled examples for the noise classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions import signal
from soundquay.functions.text import hash_number
from soundquay.operators.corpus import sample_cells
from soundquay.operators.order import number_rows


def labelled_examples(
    signals: DataFrame, key: str, per_subtype: int, seed: int = fixed.SEED
) -> DataFrame:
    """Raw noise and one mixture per sampled clip, and the clean signals.

    ``signals(key, subtype, recording_id, x)``; whole clips are sampled, so a split by recording
    stays intact. The clean partner and the level of a mixture are hashes of the clip's key.
    """
    clips = sample_cells(
        signals.filter(F.col("subtype") != fixed.CLEAN), ["subtype"], key, per_subtype, seed
    )
    clean = signals.filter(F.col("subtype") == fixed.CLEAN).select(key, "x")
    pool = number_rows(clean, [key], (), "_idx").select("_idx", F.col("x").alias("_clean"))
    size = clean.agg(F.count(F.lit(1)).alias("_n"))
    levels = list(fixed.CANONICAL_LEVELS)
    level = F.pmod(hash_number(F.col(key), F.lit("level"), seed=seed), F.lit(len(levels)))
    snr = F.get(F.array(*[F.lit(fixed.LEVEL_SNR_DB[x]) for x in levels]), level.cast("int"))
    partner = F.pmod(hash_number(F.col(key), F.lit("clean"), seed=seed), F.col("_n"))
    dealt = clips.crossJoin(F.broadcast(size)).withColumn("_idx", partner)  # one row: a count
    paired = (
        dealt.join(pool, "_idx")
        .withColumn("_level", signal.rms(F.col("_clean")))
        .withColumn("_gain", signal.mix_gain(F.col("x"), F.col("_level"), snr))
    )

    def rows(df: DataFrame, label, group, kind: str, z) -> DataFrame:
        return df.select(
            key, label.alias("label"), group.alias("grp"), F.lit(kind).alias("kind"), z.alias("z")
        )

    one = F.lit(1.0)
    return (
        rows(clips, F.col("subtype"), F.col("recording_id"), "raw", signal.scale(F.col("x"), one))
        .unionByName(
            rows(
                paired,
                F.col("subtype"),
                F.col("recording_id"),
                "mixed",
                signal.mix(F.col("_clean"), F.col("x"), F.col("_gain")),
            )
        )
        .unionByName(
            rows(clean, F.lit(fixed.CLEAN), F.lit("clean"), "clean", signal.scale(F.col("x"), one))
        )
    )
