"""Transcript guard: speech gate, segment filters, repetition cut, flags, language clamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.bind import let
from soundquay.functions.text import raw_words


def speech_ratio(intervals: Column, duration_s: Column) -> Column:
    """Share of the signal covered by the speech intervals, at most 1, 0 for an empty signal."""
    covered = F.aggregate(intervals, F.lit(0.0), lambda acc, s: acc + (s["end"] - s["start"]))
    return F.when(duration_s > 0, F.least(F.lit(1.0), covered / duration_s)).otherwise(0.0)


def is_gated(ratio: Column, minimum: float = fixed.MIN_SPEECH_RATIO) -> Column:
    return ratio < minimum


def gate_low_speech(df: DataFrame, minimum: float = fixed.MIN_SPEECH_RATIO) -> DataFrame:
    """Rows with too little speech get an empty Spanish transcript and the gate flag.

    Needs ``speech_ratio, text, language, guard_flags``; adds ``gated`` so that later, costly
    stages can be filtered on it.
    """
    gated = is_gated(F.col("speech_ratio"), minimum)
    return df.select(
        *[c for c in df.columns if c not in ("text", "language", "guard_flags")],
        F.when(gated, "").otherwise(F.col("text")).alias("text"),
        F.when(gated, "es").otherwise(F.col("language")).alias("language"),
        F.when(gated, F.array(F.lit(fixed.FLAG_GATED)))
        .otherwise(F.col("guard_flags"))
        .alias("guard_flags"),
        gated.alias("gated"),
    )


def clamp_language(probabilities: Column, detected: Column) -> Column:
    """The likelier of es/en (a tie is es); without probabilities, the detected one or es."""
    es = F.element_at(probabilities, "es")
    en = F.element_at(probabilities, "en")
    by_probability = F.when(
        F.coalesce(es, F.lit(0.0)) >= F.coalesce(en, F.lit(0.0)), "es"
    ).otherwise("en")
    return (
        F.when(F.size(probabilities) > 0, by_probability)
        .when(detected.isin(*fixed.LANGS), detected)
        .otherwise("es")
    )


def is_silent(segment: Column) -> Column:
    return (segment["no_speech_prob"] > fixed.NO_SPEECH_PROB_MAX) & (
        segment["avg_logprob"] < fixed.SEGMENT_LOGPROB_MIN
    )


def keep_spoken(segments: Column) -> Column:
    return F.filter(segments, lambda s: ~is_silent(s))


def overlaps(segment: Column, interval: Column) -> Column:
    return (segment["start"] < interval["end"]) & (segment["end"] > interval["start"])


def keep_overlapping(segments: Column, intervals: Column) -> Column:
    """Segments that overlap a speech interval; no intervals at all means no filter."""
    return F.when(
        F.size(intervals) > 0,
        F.filter(segments, lambda s: F.exists(intervals, lambda v: overlaps(s, v))),
    ).otherwise(segments)


def join_segments(segments: Column) -> Column:
    return F.trim(F.array_join(F.transform(segments, lambda s: F.trim(s["text"])), " "))


def _first_repeat(words: Column, n: int, times: int) -> Column:
    last = F.size(words) - n * times

    def repeats(i: Column) -> Column:
        block = F.slice(words, i + 1, n)
        return F.slice(words, i + 1, n * times) == F.flatten(F.array_repeat(block, times))

    return F.when(
        last >= 0, F.array_min(F.filter(F.sequence(F.lit(0), last), repeats))
    )


def first_repeat(words: Column, n: int, times: int) -> Column:
    """Zero-based place of the first n-gram that comes ``times`` times in a row, or null."""
    return let(words, lambda w: _first_repeat(w, n, times))


def cut_repetition(
    text: Column, n: int = fixed.REPEAT_NGRAM, times: int = fixed.REPEAT_TIMES
) -> Column:
    """Cut after the first copy of a repeated n-gram: ``struct<text, was_cut>``."""

    def cut(words: Column) -> Column:
        return let(
            _first_repeat(words, n, times),
            lambda at: F.struct(
                F.when(at.isNotNull(), F.array_join(F.slice(words, 1, at + n), " "))
                .otherwise(text)
                .alias("text"),
                at.isNotNull().alias("was_cut"),
            ),
        )

    return let(raw_words(text), cut)


def guard_fired(flags: Column) -> Column:
    """The gate flag does not count: a gated row never had a transcript to distrust."""
    return F.arrays_overlap(flags, F.array(*[F.lit(f) for f in fixed.GUARD_FLAGS]))


def apply_guard(
    df: DataFrame,
    segments: str = "segments",
    intervals: str | None = "vad",
    flags: str = "guard_flags",
) -> DataFrame:
    """Drop silent and off-speech segments, join the rest, cut repetitions, collect the flags.

    One chain of narrow projections; replaces ``segments``/``flags`` and sets ``text``.
    """
    spoken = df.withColumn("_spoken", keep_spoken(F.col(segments)))
    kept = (
        keep_overlapping(F.col("_spoken"), F.col(intervals)) if intervals else F.col("_spoken")
    )
    joined = spoken.withColumn("_kept", kept).withColumn("_text", join_segments(F.col("_kept")))
    cut = joined.withColumn("_cut", cut_repetition(F.col("_text"))).withColumn(
        "text", F.col("_cut.text")
    )
    raised = F.array_compact(
        F.array(
            F.when(F.size("_spoken") < F.size(segments), fixed.FLAG_LOW_SPEECH),
            F.when(F.size("_kept") < F.size("_spoken"), fixed.FLAG_VAD),
            F.when(F.col("_cut.was_cut"), fixed.FLAG_REPEAT),
        )
    )
    before = F.col(flags) if flags in df.columns else F.array().cast("array<string>")
    return (
        cut.withColumn(flags, F.array_distinct(F.concat(before, raised)))
        .withColumn(segments, F.col("_kept"))
        .drop("_spoken", "_kept", "_text", "_cut")
    )
