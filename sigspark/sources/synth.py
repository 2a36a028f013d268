"""Synthetic signals: click tracks, sines and seeded noise, made where they are used."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def click(i: Column, bpm: float, sample_rate: float) -> Column:
    """Sample ``i`` of a click track: at each beat a click of 64 samples that fades as exp(-k / 10)."""
    k = F.pmod(i, F.lit(int(sample_rate * 60 / bpm)))
    return F.when(k < 64, F.exp(-k / 10.0)).otherwise(0.0)


def wave(i: Column, frequency: float, sample_rate: float, level: float, offset: float = 0.0) -> Column:
    """Sample ``i`` of a sine whose RMS is ``level`` dB below full scale, plus an offset."""
    return F.sin(i * F.lit(2 * np.pi * frequency / sample_rate)) * (10 ** (level / 20) * 2**0.5) + offset


def click_track(spark: SparkSession, bpm: float, sample_rate: float = 44100, seconds: float = 10) -> DataFrame:
    """Rows (idx, value) of ``click``."""
    return spark.range(int(sample_rate * seconds)).select(F.col("id").alias("idx"), click(F.col("id"), bpm, sample_rate).alias("value"))


def sine(spark: SparkSession, frequency: float, sample_rate: float, seconds: float, level: float, offset: float = 0.0) -> DataFrame:
    """Rows (idx, value) of ``wave``."""
    return spark.range(int(sample_rate * seconds)).select(F.col("id").alias("idx"), wave(F.col("id"), frequency, sample_rate, level, offset).alias("value"))


def generated(spark: SparkSession, signal_id: str, sample_rate: float, seconds: float, value: Callable[[Column], Column]) -> DataFrame:
    """One row of ``SIGNAL_PACKED``, made in place from what ``value`` says of each sample's number: no rows are gathered."""
    at = F.sequence(F.lit(0).cast("long"), F.lit(int(sample_rate * seconds) - 1).cast("long"))
    samples = F.transform(at, lambda i: value(i).cast("float"))
    return spark.range(1, numPartitions=1).select(F.lit(signal_id).alias("signal_id"), F.lit(float(sample_rate)).alias("sample_rate"), samples.alias("samples"))


def sine_sections(spark: SparkSession, frequency: float, sample_rate: float, seconds: float, levels: list[float]) -> DataFrame:
    """Rows (idx, value): one sine of ``seconds`` after another, each from its start and at its level (loud, quiet, loud)."""
    n = int(sample_rate * seconds)
    amplitude = F.element_at(F.array(*[F.lit(10 ** (v / 20) * 2**0.5) for v in levels]), (F.floor(F.col("id") / n) + 1).cast("int"))
    phase = 2 * np.pi * frequency / sample_rate
    return spark.range(n * len(levels)).select(F.col("id").alias("idx"), (F.sin((F.col("id") % n) * F.lit(phase)) * amplitude).alias("value"))


def splitmix64(seed: int, n: int, start: int = 0) -> np.ndarray:
    """Values ``start`` .. ``start + n - 1`` of the generator; each follows from its number alone."""
    # Fixed values of SplitMix64.
    gamma, first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(start + 1, start + n + 1, dtype=np.uint64) * gamma
        z = (z ^ (z >> np.uint64(30))) * first
        z = (z ^ (z >> np.uint64(27))) * second
        return z ^ (z >> np.uint64(31))


def noise(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """Rows (idx, value) of uniform noise in -1..1."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("id").to_numpy()
            if len(at):
                value = splitmix64(seed, len(at), int(at[0])).astype(np.float64) / float(2**64 - 1) * 2 - 1
                yield pa.record_batch({"idx": at, "value": value})

    return spark.range(n).mapInArrow(make, "idx long, value double")


def packed(df: DataFrame, signal_id: str, sample_rate: float) -> DataFrame:
    """One row of ``SIGNAL_PACKED`` from rows (idx, value); its samples are one array by nature."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("float").alias("v")))), lambda x: x["v"])
    return df.agg(ordered.alias("samples")).select(F.lit(signal_id).alias("signal_id"), F.lit(float(sample_rate)).alias("sample_rate"), "samples")
