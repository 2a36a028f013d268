"""Momentary loudness of a stream of samples: an extension beyond whole-signal analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalar import floor_lufs, loudness


def momentary_loudness(samples: DataFrame, window: str = "400 milliseconds", step: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(signal_id, start, lufs) of hopping windows over rows (signal_id, ts, value), streaming or not; samples later than ``late`` are left out of a stream."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    sums = rows.groupBy("signal_id", F.window("ts", window, step).alias("w")).agg(F.avg(F.col("value") * F.col("value")).alias("ms"))
    return sums.select("signal_id", F.col("w.start").alias("start"), floor_lufs(loudness(F.col("ms"))).alias("lufs"))
