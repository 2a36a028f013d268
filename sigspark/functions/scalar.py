"""Scalar functions as columns, and the same as SQL functions."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sigspark import schema as S


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def bound(*names: str):
    """Decorator: the named arguments are evaluated once before the function's body uses them.

    Without it the optimizer may write an argument's expression into a lambda that runs for
    each element of an array.
    """

    def wrap(fn):
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def call(*args, **kwargs):
            given = signature.bind(*args, **kwargs)
            return let(F.struct(*[given.arguments[n].alias(n) for n in names]), lambda s: fn(**{**given.arguments, **{n: s[n] for n in names}}))

        return call

    return wrap


def hz_to_mel(hz: Column) -> Column:
    return F.lit(2595.0) * F.log10(1 + hz / F.lit(700.0))


def mel_to_hz(mel: Column) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), mel / F.lit(2595.0)) - 1)


def range_normalize(bpm: Column) -> Column:
    """Doubled or halved into 60..200, both ends included; null for 0 and less."""
    low, high = F.lit(S.PERCEPTUAL_MIN), F.lit(S.PERCEPTUAL_MAX)
    up = bpm * F.pow(F.lit(2.0), F.ceil(F.log2(low / bpm)).cast("double"))
    up = F.when(up / 2 >= low, up / 2).when(up < low, up * 2).otherwise(up)
    down = bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / high)).cast("double"))
    down = F.when(down * 2 <= high, down * 2).when(down > high, down / 2).otherwise(down)
    return F.when(bpm <= 0, None).when(bpm < low, up).when(bpm > high, down).otherwise(bpm)


def interpolate_linear(values: Column, n: Column, lag: Column) -> Column:
    """Between the samples about ``lag``; the lower one at the end of ``n`` values, 0 beyond."""

    def at(i: Column) -> Column:
        a, b = F.get(values, i), F.get(values, i + 1)
        return F.when(i.isNull() | (i < 0) | (i >= n), F.lit(0.0)).when(i + 1 >= n, a).otherwise(a + (b - a) * (lag - i))

    return let(F.floor(lag).cast("int"), at)


def interpolate_parabolic(values: Column, n: Column, lag: Column) -> Column:
    """On the parabola through the three samples about ``lag`` (halves round away from 0); linear at the ends."""

    def at(k: Column) -> Column:
        y0, y1, y2, t = F.get(values, k - 1), F.get(values, k), F.get(values, k + 1), lag - k
        curve = y1 + t * (y2 - y0) / 2 + t * t * (y0 - 2 * y1 + y2) / 2
        return F.when((k < 1) | (k + 1 >= n), interpolate_linear(values, n, lag)).otherwise(curve)

    return let(F.floor(lag + 0.5).cast("int"), at)


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is ``n`` or more; 1 for 1 and less."""
    k = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def bpm_to_lag(bpm: Column, onset_rate: Column) -> Column:
    return 60 * onset_rate / bpm


def loudness(mean_square: Column) -> Column:
    """In LUFS; null stands for minus infinity."""
    return F.when(mean_square > 0, F.lit(S.LUFS_OFFSET) + 10 * F.log10(mean_square))


def mean_square(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, total / F.size(samples))


def rms(samples: Column) -> Column:
    return F.sqrt(mean_square(samples))


def log_compress(energy: Column) -> Column:
    return F.log1p(F.lit(S.LOG_SCALE) * energy)


def rectify(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def hann(i: Column, size: Column | int) -> Column:
    """The periodic window: the denominator is ``size``."""
    return F.lit(0.5) * (1 - F.cos(2 * F.pi() * i / (F.lit(size) if isinstance(size, int) else size)))


def floor_lufs(value: Column) -> Column:
    return F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(S.LUFS_FLOOR))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


#: Bodies of the SQL functions.
SQL_FUNCTIONS = {
    "hz_to_mel(hz DOUBLE)": "2595.0D * log10(1 + hz / 700.0D)",
    "mel_to_hz(mel DOUBLE)": "700.0D * (pow(10.0D, mel / 2595.0D) - 1)",
    "bpm_to_lag(bpm DOUBLE, onset_rate DOUBLE)": "60 * onset_rate / bpm",
    "loudness(mean_square DOUBLE)": "CASE WHEN mean_square > 0 THEN -0.691D + 10 * log10(mean_square) END",
    "log_compress(energy DOUBLE)": "log1p(100.0D * energy)",
    "hann(i DOUBLE, size DOUBLE)": "0.5D * (1 - cos(2 * pi() * i / size))",
    "clamp01(x DOUBLE)": "least(1.0D, greatest(0.0D, x))",
    "range_normalize(bpm DOUBLE)": """CASE WHEN bpm <= 0 THEN NULL
        WHEN bpm < 60 THEN bpm * pow(2.0D, ceil(log2(60.0D / bpm)) + CASE WHEN bpm * pow(2.0D, ceil(log2(60.0D / bpm)) - 1) >= 60 THEN -1 WHEN bpm * pow(2.0D, ceil(log2(60.0D / bpm))) < 60 THEN 1 ELSE 0 END)
        WHEN bpm > 200 THEN bpm / pow(2.0D, ceil(log2(bpm / 200.0D)) + CASE WHEN bpm / pow(2.0D, ceil(log2(bpm / 200.0D)) - 1) <= 200 THEN -1 WHEN bpm / pow(2.0D, ceil(log2(bpm / 200.0D))) > 200 THEN 1 ELSE 0 END)
        ELSE bpm END""",
    "interpolate_linear(v ARRAY<DOUBLE>, n INT, lag DOUBLE)": """CASE WHEN lag IS NULL OR lag < 0 OR floor(lag) >= n THEN 0.0D
        WHEN floor(lag) + 1 >= n THEN get(v, int(floor(lag)))
        ELSE get(v, int(floor(lag))) + (get(v, int(floor(lag)) + 1) - get(v, int(floor(lag)))) * (lag - floor(lag)) END""",
    "interpolate_parabolic(v ARRAY<DOUBLE>, n INT, lag DOUBLE)": """CASE WHEN floor(lag + 0.5D) < 1 OR floor(lag + 0.5D) + 1 >= n THEN interpolate_linear(v, n, lag)
        ELSE get(v, int(floor(lag + 0.5D))) + (lag - floor(lag + 0.5D)) * (get(v, int(floor(lag + 0.5D)) + 1) - get(v, int(floor(lag + 0.5D)) - 1)) / 2
          + (lag - floor(lag + 0.5D)) * (lag - floor(lag + 0.5D)) * (get(v, int(floor(lag + 0.5D)) - 1) - 2 * get(v, int(floor(lag + 0.5D))) + get(v, int(floor(lag + 0.5D)) + 1)) / 2 END""",
}


def register(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL in this session; they are expanded into the plan."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
