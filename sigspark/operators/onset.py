"""Onset envelopes: frames, power, mel, log, difference, rectify, sum by band."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions.scalar import log_compress, rectify
from sigspark.operators.mel import filterbank_matrix
from sigspark.operators.spectral import frame_powers
from sigspark.operators.windows import difference

_banks: dict[float, np.ndarray] = {}


def envelopes(samples: np.ndarray, sample_rate: float) -> np.ndarray:
    """5 x frames: all bands, then the four sub-bands; none for fewer than two frames."""
    if sample_rate not in _banks:
        _banks[sample_rate] = filterbank_matrix(sample_rate).T
    bank, before, parts = _banks[sample_rate], None, []
    for power in frame_powers(samples, int(sample_rate / 100)):
        logs = np.log1p(S.LOG_SCALE * (power @ bank))
        joined = logs if before is None else np.vstack([before, logs])
        before = logs[-1:]
        rise = np.maximum(np.diff(joined, axis=0), 0)
        parts.append(np.vstack([rise.sum(1), *(rise[:, a:b].sum(1) for a, b in S.BANDS.values())]))
    return np.hstack(parts) if parts else np.zeros((5, 0))


def onset_long(energies: DataFrame, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """(signal_id, frame, full, one column a band) from mel energies (signal_id, frame, band, energy)."""
    logs = energies.withColumn("v", log_compress(F.col("energy")))
    rise = difference(logs, ["signal_id", "band"], "frame", "v").withColumn("v", rectify(F.col("v")))
    parts = [F.sum(F.when((F.col("band") >= a) & (F.col("band") < b), F.col("v")).otherwise(0.0)).alias(name) for name, (a, b) in bands.items()]
    return rise.groupBy("signal_id", "frame").agg(F.sum("v").alias("full"), *parts)
