"""The training draw reaches its hours, keeps its clean share and refuses missing clips."""

import pytest
from pyspark.sql import functions as F

from soundquay.operators import corpus

POOL = "lang string, utterance_id string, text string, duration_s double"
WEIGHTS = [(lang, st, w) for lang in ("es", "en") for st, w in (("AA", 0.4), ("BB", 0.6))]


def _draw(spark, hours, clips=("AA", "BB"), rows=40, seconds=9.0):
    pool = spark.createDataFrame(
        [(lang, f"{lang}{i}", "t", seconds) for lang in ("es", "en") for i in range(rows)], POOL)
    bank = spark.createDataFrame([(st, f"{st}{i}") for st in clips for i in range(5)], "subtype string, clip_id string")
    weights = spark.createDataFrame(WEIGHTS, "lang string, noise_subtype string, weight double")
    return corpus.draw_training(pool, bank, weights, corpus.levels_table(spark), hours)


def test_hours_and_shares(spark):
    out = _draw(spark, 2.0)
    row = out.agg(F.sum("duration_s").alias("s"), F.avg(F.col("noise_clip_id").isNull().cast("int")).alias("clean"),
                  F.count("*").alias("n"), F.countDistinct("utterance_id").alias("ids")).first()
    assert 7200 <= row["s"] < 7209 and row["n"] == row["ids"]
    assert abs(row["clean"] - 0.3) < 0.06
    noisy = out.filter("noise_subtype is not null")
    assert noisy.filter("noise_clip_id is null or noise_band is null").count() == 0


def test_missing_clips_are_an_error(spark):
    with pytest.raises(ValueError, match="BB"):
        _draw(spark, 0.1, clips=("AA",))


def test_pool_without_audio_is_an_error(spark):
    with pytest.raises(ValueError, match="audio"):
        _draw(spark, 0.1, seconds=0.0)
