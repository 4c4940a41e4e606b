"""Loops and windows of short signals against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundquay.functions import signal


def plain_loop(x, n, overlap):
    x = np.asarray(x, float)
    if len(x) >= n or not len(x):
        return x
    lap = min(overlap, len(x) // 2)
    if not lap:
        return np.resize(x, n)
    step = len(x) - lap
    ramp = np.sin(np.linspace(0, np.pi / 2, lap)) ** 2
    copies = -(-(n - len(x)) // step) + 1
    out = np.zeros(len(x) + step * (copies - 1))
    for k in range(copies):
        part = x.copy()
        if k:
            part[:lap] *= ramp
        if k < copies - 1:
            part[-lap:] *= ramp[::-1]
        out[k * step:k * step + len(x)] += part
    return out[:n]


@pytest.mark.parametrize("overlap", [1, 2, 8])
def test_loops(spark, overlap):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=m).tolist(), n) for i, (m, n) in enumerate(
        [(1, 5), (2, 7), (3, 10), (16, 17), (16, 100), (17, 101), (9, 9), (20, 5), (0, 4), (64, 150)])]
    df = spark.createDataFrame(rows, "id int, x array<double>, n int")
    got = {r["id"]: r["x"] for r in signal.loop_to_length(df, "x", "n", overlap).collect()}
    for i, x, n in rows:
        assert np.allclose(got[i], plain_loop(x, n, overlap)), (i, overlap)


def test_windows_of_a_width_per_row(spark):
    rows = [(0, [1.0, 2.0, 3.0], 4), (1, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (2, [], 2)]
    df = spark.createDataFrame(rows, "id int, x array<double>, w int")
    out = signal.full_windows(df, "x", F.col("w"), 2).orderBy("id", "clip_start").collect()
    assert [(r["id"], r["clip_start"], r["clip"]) for r in out] == [
        (0, 0, [1.0, 2.0, 3.0, 0.0]), (1, 0, [1.0, 2.0]), (1, 2, [3.0, 4.0]), (2, 0, [0.0, 0.0])]
