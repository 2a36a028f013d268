"""Mixing channels down to one signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mix_stereo(left: Column, right: Column) -> Column:
    """(left + right) / 2 of two arrays, in the arrays' own precision."""
    return F.zip_with(left, right, lambda a, b: ((a + b) / F.lit(2).cast("float")).cast("float"))


def mix_channels(channels: Column) -> Column:
    """The mean of any number of arrays, summed in float; one channel stays as it is."""
    first = F.get(channels, F.lit(0))
    total = F.aggregate(F.slice(channels, 2, F.size(channels)), first, lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.when(F.size(channels) == 1, first).otherwise(F.transform(total, lambda x: (x / F.size(channels)).cast("float")))


def mix_long(channels: DataFrame) -> DataFrame:
    """Rows (signal_id, idx, value) from (signal_id, channel, idx, value)."""
    return channels.groupBy("signal_id", "idx").agg(F.avg("value").alias("value"))


def take_seconds(samples: Column, sample_rate: Column, seconds: float | None) -> Column:
    """The first ``seconds`` of an array of samples; negative times take nothing, null takes all."""
    if seconds is None:
        return samples
    frames = F.greatest(F.lit(0), F.floor(sample_rate * F.lit(float(max(0.0, seconds))))).cast("int")
    return F.slice(samples, F.lit(1), F.least(frames, F.size(samples)))
