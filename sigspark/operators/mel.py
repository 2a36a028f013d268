"""The mel filterbank as a sparse table, and projection on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions.scalar import hz_to_mel, mel_to_hz


def filterbank(spark: SparkSession, sample_rate: float, bands: int = S.MEL_BANDS, fft_size: int = S.FFT_SIZE, fmin: float = S.FMIN, fmax: float | None = None) -> DataFrame:
    """(sample_rate, band, bin, weight) of the cells that are not 0: area-normalised triangles, evenly spaced in mel."""
    fmax = min(sample_rate / 2, S.FMAX) if fmax is None else fmax
    low, high = hz_to_mel(F.lit(float(fmin))), hz_to_mel(F.lit(float(fmax)))
    edge = lambda i: F.floor(fft_size * mel_to_hz(low + (high - low) * i / (bands + 1)) / sample_rate).cast("int")
    rows = spark.range(bands).select(F.col("id").cast("int").alias("band"), edge(F.col("id")).alias("l"), edge(F.col("id") + 1).alias("c"), edge(F.col("id") + 2).alias("r"))
    last = fft_size // 2 - 1
    rows = rows.where((F.col("r") > F.col("l")) & (F.col("l") <= last))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.col("l"), F.least("r", F.lit(last)))))
    rising = F.when((F.col("c") > F.col("l")) & (F.col("bin") <= F.col("c")), (F.col("bin") - F.col("l")) / (F.col("c") - F.col("l")))
    falling = F.when((F.col("r") > F.col("c")) & (F.col("bin") >= F.col("c")), (F.col("r") - F.col("bin")) / (F.col("r") - F.col("c")))
    weight = F.coalesce(falling, rising, F.lit(0.0)) * 2 / (F.col("r") - F.col("l"))
    return rows.select(F.lit(float(sample_rate)).alias("sample_rate"), "band", "bin", weight.alias("weight")).where("weight != 0")


def filterbank_matrix(sample_rate: float) -> np.ndarray:
    """The same as a matrix of bands x bins, for the vectorised transform."""
    top = 2595 * np.log10(1 + min(sample_rate / 2, S.FMAX) / 700)
    base = 2595 * np.log10(1 + S.FMIN / 700)
    mels = base + (top - base) * np.arange(S.MEL_BANDS + 2) / (S.MEL_BANDS + 1)
    edges = np.floor(S.FFT_SIZE * (700 * (10 ** (mels / 2595) - 1)) / sample_rate).astype(int)
    l, c, r = (edges[i : i + S.MEL_BANDS, None] for i in range(3))  # noqa: E741
    k = np.arange(S.BINS)
    rising = np.where((c > l) & (k >= l) & (k <= c), (k - l) / np.maximum(1, c - l), 0.0)
    falling = np.where((r > c) & (k >= c) & (k <= r), (r - k) / np.maximum(1, r - c), np.nan)
    return np.where(np.isnan(falling), rising, falling) * 2 / np.maximum(1, r - l)


def project(spectrum: DataFrame, bank: DataFrame) -> DataFrame:
    """(signal_id, frame, band, energy) from (signal_id, frame, bin, power). The bank has at most a few cells for each bin."""
    joined = spectrum.join(F.broadcast(bank.select("band", "bin", "weight")), "bin")
    return joined.groupBy("signal_id", "frame", "band").agg(F.sum(F.col("power") * F.col("weight")).alias("energy"))
