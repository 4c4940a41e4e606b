"""Short signals as ``array<double>`` columns: levels, mixing, windows, logits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.bind import let

_SILENCE = 1e-9
_MIX_PEAK = 0.99
_OVERLAY_PEAK = 0.9


def rms(x: Column) -> Column:
    """Root mean square, 0 for an empty signal."""
    energy = F.aggregate(
        x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
    )
    return F.when(F.size(x) > 0, F.sqrt(energy / F.size(x))).otherwise(0.0)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), F.lit(0.0))


def speech_rms(x: Column, intervals: Column, rate: int) -> Column:
    """RMS over the samples inside the union of the intervals (bounds rounded half to even)."""
    inside = F.filter(
        x,
        lambda _, i: F.exists(
            intervals,
            lambda s: (i >= F.bround(s["start"] * rate)) & (i < F.bround(s["end"] * rate)),
        ),
    )
    return rms(inside)


def scale(x: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(x, lambda v: v.cast("double") * f))


def limit_peak(x: Column, top: float) -> Column:
    """Scale the whole signal down when its peak is above ``top``."""
    return let(
        F.transform(x, lambda v: v.cast("double")),
        lambda s: let(
            peak(s), lambda high: F.when(high > top, scale(s, F.lit(top) / high)).otherwise(s)
        ),
    )


def mix_gain(noise: Column, speech_level: Column, snr_db: Column) -> Column:
    """Gain for the noise so that speech sits ``snr_db`` above it; 0 when either is silent."""
    noise_level = rms(noise)
    return F.when((noise_level < _SILENCE) | (speech_level < _SILENCE), 0.0).otherwise(
        speech_level / (noise_level * F.pow(F.lit(10.0), snr_db / 20.0))
    )


def mix(clean: Column, noise: Column, gain: Column) -> Column:
    """``clean + gain * noise`` with the whole mix scaled below the peak limit."""
    both = let(
        gain,
        lambda g: F.zip_with(clean, noise, lambda c, n: c.cast("double") + g * n.cast("double")),
    )
    return F.when(gain == 0.0, F.transform(clean, lambda v: v.cast("double"))).otherwise(
        limit_peak(both, _MIX_PEAK)
    )


def achieved_snr_db(noise: Column, speech_level: Column, gain: Column) -> Column:
    return F.when(gain == 0.0, F.lit(float("inf"))).otherwise(
        20.0 * F.log10(speech_level / (gain * rms(noise)))
    )


def noise_window(noise: Column, n: Column, key: Column) -> Column:
    """``n`` samples from a place that depends on ``key`` only (repeatable)."""
    return F.slice(noise, F.pmod(key, F.size(noise) - n + 1) + 1, n)


def tile(x: Column, n: Column) -> Column:
    """Repeat a signal end to end up to ``n`` samples, or cut it there."""
    copies = F.ceil(n / F.size(x)).cast("int")
    return F.slice(F.flatten(F.array_repeat(x, copies)), 1, n)


def fit_length(x: Column, n: Column) -> Column:
    """Cut or zero-pad to exactly ``n`` samples."""
    as_double = F.transform(x, lambda v: v.cast("double"))
    return F.slice(F.concat(as_double, F.array_repeat(F.lit(0.0), n)), 1, n)


def overlay(bed: Column, voice: Column, rel_db: float) -> Column:
    """Voice laid over a bed at ``rel_db`` against the bed; null when either is silent."""

    def lay(fitted: Column) -> Column:
        bed_level, voice_level = rms(bed), rms(fitted)
        both = let(
            bed_level * (10.0 ** (rel_db / 20.0)) / voice_level,
            lambda gain: F.zip_with(
                bed, fitted, lambda b, v: b.cast("double") + gain * v.cast("double")
            ),
        )
        audible = (bed_level >= _SILENCE) & (voice_level >= _SILENCE)
        return F.when(audible, limit_peak(both, _OVERLAY_PEAK))

    return let(tile(voice, F.size(bed)), lay)


def cut_clips(
    df: DataFrame, signal: str, clip_len: int | Column, hop: int, min_len: int | Column
) -> DataFrame:
    """One row per clip ``[i, i + clip_len)`` for i = 0, hop, ... while ``min_len`` samples remain."""
    last = F.size(signal) - min_len
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop)))
    return df.withColumn("clip_start", F.explode(starts)).withColumn(
        "clip", F.slice(signal, F.col("clip_start") + 1, clip_len)
    )


def full_windows(df: DataFrame, signal: str, width: int | Column, hop: int) -> DataFrame:
    """Windows of ``width`` (one for all rows, or a column); a short signal is zero-padded to one."""
    width = F.lit(width) if isinstance(width, int) else width
    padded = F.when(F.size(signal) < width, fit_length(F.col(signal), width)).otherwise(
        F.transform(signal, lambda v: v.cast("double"))
    )
    return cut_clips(df.withColumn("_padded", padded), "_padded", width, hop, width).drop("_padded")


def mean_vector(windows: Column) -> Column:
    """Element-wise mean of an ``array<array<double>>``."""
    n = F.size(windows)
    total = F.aggregate(
        F.slice(windows, 2, F.greatest(n - 1, F.lit(0))),
        F.transform(windows[0], lambda v: v.cast("double")),
        lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b.cast("double")),
    )
    return F.transform(total, lambda v: v / n)


def decide(logits: Column, classes: list[str], min_confidence: float) -> tuple[Column, Column]:
    """Softmax and arg-max with the confidence gate: ``(subtype or null, confidence)``."""
    top = F.array_max(logits)
    weights = let(top, lambda t: F.transform(logits, lambda v: F.exp(v - t)))
    confidence = F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    label = F.element_at(
        F.array(*[F.lit(c) for c in classes]), F.array_position(logits, top).cast("int")
    )
    subtype = F.when((label != fixed.CLEAN) & (confidence >= min_confidence), label)
    return subtype, confidence


def looped(x: Column, n: Column, overlap: int) -> Column:
    """Loop a signal to ``n`` samples; each further copy fades in over the end of the one before.

    A copy starts ``overlap`` samples (half the signal at most) before the end of the last, so a
    sample belongs to two copies at most and is worked out from its place alone. A signal that is
    long enough is left as it is.
    """
    half_pi = math.pi / 2

    def samples(v: Column) -> Column:
        size = F.size(v)
        lap = F.least(F.lit(overlap), F.floor(size / 2).cast("int"))
        step = size - lap
        last = F.ceil((n - size) / step).cast("int")

        def ramp(i: Column) -> Column:
            return F.when(lap > 1, F.pow(F.sin(i * half_pi / (lap - 1)), 2)).otherwise(0.0)

        def share(t: Column, k: Column) -> Column:
            i = t - k * step
            rise = F.when((k > 0) & (i < lap), ramp(i)).otherwise(1.0)
            fall = F.when((k < last) & (i >= size - lap), ramp(size - 1 - i)).otherwise(1.0)
            return F.when((k >= 0) & (k <= last) & (i < size), F.get(v, i) * rise * fall).otherwise(0.0)

        def sample(t: Column) -> Column:
            return let(F.floor(t / step).cast("int"), lambda k: share(t, k) + share(t, k - 1))

        places = F.sequence(F.lit(0), n - 1)
        repeated = F.transform(places, lambda t: F.get(v, F.pmod(t, size)))
        return F.when((size >= n) | (size == 0), v).when(lap == 0, repeated).otherwise(F.transform(places, sample))

    return let(F.transform(x, lambda v: v.cast("double")), samples)


def loop_to_length(df: DataFrame, signal: str, length: str, overlap: int) -> DataFrame:
    """Loop short signals up to ``length`` samples with a squared cosine/sine crossfade."""
    return df.withColumn(signal, looped(F.col(signal), F.col(length).cast("int"), overlap))
