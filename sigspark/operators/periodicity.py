"""Periodicity of envelopes: autocorrelation, Fourier tempogram, their fusion. Arrays in, arrays out: no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions.scalar import bound, bpm_to_lag, hann, interpolate_parabolic, let


def lags_read(onset_rate: float) -> int:
    """Lags that anything reads: up to that of the slowest tempo and its neighbour."""
    return math.ceil(60 * onset_rate / S.BPM_MIN) + 2


def grid() -> Column:
    return F.sequence(F.lit(S.BPM_MIN), F.lit(S.BPM_MAX))


@bound("values")
def autocorrelation(values: Column, lags: int = lags_read(100.0)) -> Column:
    """Sums of x[i] * x[i + k] for k = 0 .. lags - 1, fewer for shorter arrays; by default all that a rate of 100 needs."""
    n = F.size(values)
    lag = lambda k: F.aggregate(
        F.zip_with(F.slice(values, F.lit(1), n - k), F.slice(values, k + 1, n - k), lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.least(F.lit(lags - 1), n - 1)), lag)).otherwise(F.array().cast("array<double>"))


@bound("values")
def windowed_prefix(values: Column, onset_rate: Column) -> Column:
    """The first 8 seconds under a periodic Hann window of their length."""
    n = F.least(F.size(values), F.floor(onset_rate * S.TEMPOGRAM_SECONDS).cast("int"))
    return F.transform(F.slice(values, F.lit(1), n), lambda x, i: x.cast("double") * hann(i, n))


@bound("windowed", "bpms")
def fourier_magnitudes(windowed: Column, onset_rate: Column, bpms: Column) -> Column:
    """Magnitude of the windowed envelope's transform at each tempo."""

    def part(wave, turn: Column) -> Column:
        return F.aggregate(F.transform(windowed, lambda x, k: x * wave(turn * k)), F.lit(0.0), lambda s, x: s + x)

    def at(bpm: Column) -> Column:
        return let(2 * F.pi() * bpm / 60 / onset_rate, lambda turn: F.hypot(part(F.cos, turn), part(F.sin, turn)))

    return F.transform(bpms, at)


def scaled(values: Column) -> Column:
    """Divided by the largest if that is positive."""
    over = lambda v: let(F.array_max(v), lambda top: F.when(top > 0, F.transform(v, lambda x: x / top)).otherwise(v))
    return let(values, over)


@bound("acf", "bpms")
def acf_at_tempos(acf: Column, n: Column, onset_rate: Column, bpms: Column) -> Column:
    return F.transform(bpms, lambda b: interpolate_parabolic(acf, n, bpm_to_lag(b, onset_rate)))


def fuse(acf: Column, n: Column, tempogram: Column, onset_rate: Column) -> Column:
    """Product of both, each by its own maximum, on the grid of whole tempos."""
    return F.zip_with(scaled(acf_at_tempos(acf, n, onset_rate, grid())), scaled(tempogram), lambda a, b: a * b)


@bound("periodicity")
def enhance(periodicity: Column) -> Column:
    """Adds half of the value at half the tempo and a quarter of its neighbours'."""
    at = lambda bpm: F.when(bpm >= S.BPM_MIN, F.coalesce(F.get(periodicity, (bpm - S.BPM_MIN).cast("int")), F.lit(0.0))).otherwise(F.lit(0.0))
    half = lambda i: F.floor((i + S.BPM_MIN) / 2).cast("int")
    return F.transform(periodicity, lambda p, i: p + 0.5 * at(half(i)) + 0.25 * at(half(i) - 1) + 0.25 * at(half(i) + 1))
