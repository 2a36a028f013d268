"""Transforms and recursive filters: vectorised in Arrow batches, and native forms for short signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions.scalar import hann


def power_spectrum(frames: DataFrame, size: int) -> DataFrame:
    """(signal_id, frame, bin, power) of rows (signal_id, frame, i, value), by a sum over cosines and sines.

    The scale is 4 |DFT|^2, and bin 0 holds the first and the last bin's squares together. For
    frames of a few dozen samples; long ones go through ``frame_powers``.
    """
    windowed = frames.withColumn("x", F.col("value") * hann(F.col("i"), size)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    angle = 2 * F.pi() * F.col("i") * F.col("bin") / size
    sums = windowed.groupBy("signal_id", "frame", "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    power = 4 * (F.col("re") * F.col("re") + F.when(F.col("bin") % (size // 2) == 0, 0.0).otherwise(F.col("im") * F.col("im")))
    return sums.withColumn("power", power).groupBy("signal_id", "frame", (F.col("bin") % (size // 2)).alias("bin")).agg(F.sum("power").alias("power"))


def frame_powers(samples: np.ndarray, hop: int, block: int = 512):
    """Blocks of frames x bins of the same scale, for the full size."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(S.FFT_SIZE) / S.FFT_SIZE))
    if len(samples) < S.FFT_SIZE:
        return
    framed = np.lib.stride_tricks.sliding_window_view(samples, S.FFT_SIZE)[::hop]
    for a in range(0, len(framed), block):
        x = np.fft.rfft(framed[a : a + block] * window)
        power = 4 * (x.real**2 + x.imag**2)
        power[:, 0] = 4 * (x[:, 0].real ** 2 + x[:, -1].real ** 2)
        yield power[:, : S.BINS]


def _biquad(b0: float, b1: float, b2: float, a1: float, a2: float, x: np.ndarray) -> np.ndarray:
    y = np.empty(len(x))
    x1 = x2 = y1 = y2 = 0.0
    for i, v in enumerate(x.tolist()):
        out = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x2, x1, y2, y1 = x1, v, y1, out
        y[i] = out
    return y


_responses: dict[int, np.ndarray] = {}


def k_weighting(samples: np.ndarray, sample_rate: int) -> np.ndarray:
    """Both filters over a signal from rest, by convolution with their response cut below 1e-16."""
    if sample_rate not in _responses:
        pulse = np.zeros(int(sample_rate * 0.4))
        pulse[0] = 1
        for section in S.K_WEIGHTING[sample_rate]:
            pulse = _biquad(*section, pulse)
        big = np.flatnonzero(np.abs(pulse) > 1e-16)
        _responses[sample_rate] = pulse[: big[-1] + 1]
    h = _responses[sample_rate]
    size = 1 << (4 * len(h) - 1).bit_length()
    spectrum, step = np.fft.rfft(h, size), size - len(h) + 1
    out = np.zeros(len(samples) + size)
    for a in range(0, len(samples), step):
        part = samples[a : a + step]
        out[a : a + size] += np.fft.irfft(np.fft.rfft(part, size) * spectrum, size)
    return out[: len(samples)]


def k_weighting_column(samples: Column, sample_rate: int) -> Column:
    """The same recursion as a fold over a short array."""
    out = samples
    for b0, b1, b2, a1, a2 in S.K_WEIGHTING[sample_rate]:
        zero = F.lit(0.0)
        rest = F.struct(zero.alias("x1"), zero.alias("x2"), zero.alias("y1"), zero.alias("y2"), F.array().cast("array<double>").alias("out"))

        def step(s, v, b0=b0, b1=b1, b2=b2, a1=a1, a2=a2):
            x = v.cast("double")
            y = F.lit(b0) * x + F.lit(b1) * s["x1"] + F.lit(b2) * s["x2"] - F.lit(a1) * s["y1"] - F.lit(a2) * s["y2"]
            return F.struct(x.alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"), F.array_append(s["out"], y).alias("out"))

        out = F.aggregate(out, rest, _two(step), lambda s: s["out"])
    return out


def _two(step):
    return lambda s, v: step(s, v)
