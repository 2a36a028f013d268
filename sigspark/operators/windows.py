"""Windows over exploded signals: rows (signal_id, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark import schema as S


def explode_signal(df: DataFrame, samples: str = "samples") -> DataFrame:
    """Rows (signal_id, idx, value) from packed signals."""
    return df.select("signal_id", F.posexplode(samples).alias("idx", "value")).select("signal_id", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


#: Samples of packed signals that a task gets where each becomes many rows; a longer signal is one task's.
SPREAD = 1 << 16


def spread(packed: DataFrame, samples: str = "samples") -> DataFrame:
    """Packed signals, by ``signal_id`` in partitions of about ``SPREAD`` samples: there are more of them for more input, none larger.

    Steps by signal keep this partitioning. Spark's own goes by the bytes that are shuffled, of
    which frames, bins and bands make many times as much within a task.
    """
    total = packed.agg(F.sum(F.greatest(F.size(samples), F.lit(0)).cast("long"))).first()[0] or 0
    return packed.repartition(max(packed.sparkSession.sparkContext.defaultParallelism, -(-total // SPREAD)), "signal_id")


def rms_windows(df: DataFrame, window: int, most: int = S.ENERGY_WINDOWS) -> DataFrame:
    """(signal_id, w, rms) of the first ``most`` whole windows of ``window`` samples."""
    w = F.floor(F.col("idx") / window).cast("long")
    sums = df.groupBy("signal_id", w.alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("c"))
    return sums.where((F.col("c") == window) & (F.col("w") < most)).drop("c")


def energy_transition(df: DataFrame, window: int) -> DataFrame:
    """(signal_id, start): the first sample of the first window whose RMS exceeds twice the mean of all before; 0 if none does."""
    before = Window.partitionBy("signal_id").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    sums = rms_windows(df, window).withColumn("mean", F.avg("rms").over(before))
    fires = (F.col("w") > 0) & (F.col("rms") > S.ENERGY_FACTOR * F.greatest("mean", F.lit(S.SILENCE_RMS)))
    first = sums.groupBy("signal_id").agg(F.min(F.when(fires, F.col("w"))).alias("w"))
    signals = df.select("signal_id").distinct()
    return signals.join(first, "signal_id", "left").select("signal_id", F.coalesce(F.col("w") * window, F.lit(0)).cast("long").alias("start"))


def analysis_window(df: DataFrame, start: Column, length: int) -> DataFrame:
    """The rows from ``start`` on, at most ``length`` of them, renumbered from 0."""
    return df.where((F.col("idx") >= start) & (F.col("idx") < start + length)).withColumn("idx", F.col("idx") - start)


def frames(df: DataFrame, size: int, hop: int) -> DataFrame:
    """(signal_id, frame, i, value): all whole frames of ``size`` samples every ``hop``.

    A sample says itself which frames it is in, so nothing is joined; a frame without all its
    samples is left out by the signal's length, a number for each signal. Signals that come
    through ``spread`` are not shuffled again, neither here nor for spectra and bands.
    """
    lengths = df.groupBy("signal_id").agg((F.max("idx") + 1).alias("n"))
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - (size - 1)) / hop).cast("long"))
    high = F.least(F.floor(F.col("idx") / hop), F.floor((F.col("n") - size) / hop)).cast("long")
    rows = df.join(lengths, "signal_id").where(high >= low).withColumn("frame", F.explode(F.sequence(low, high)))
    return rows.select("signal_id", "frame", (F.col("idx") - F.col("frame") * hop).alias("i"), "value")


def difference(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``value`` less the one before it; the first of each group goes."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNotNull()).withColumn(value, F.col(value) - F.col("_before")).drop("_before")


def block_mean_squares(df: DataFrame, step: int, steps: int = 4) -> DataFrame:
    """(signal_id, block, ms) of all whole blocks of ``steps`` * ``step`` samples, one every ``step``.

    Samples are summed by step first, so that each is read once however much blocks overlap.
    """
    chunk = F.floor(F.col("idx") / step).cast("long")
    sums = df.groupBy("signal_id", chunk.alias("block")).agg(F.sum(F.col("value") * F.col("value")).alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("signal_id").orderBy("block").rowsBetween(0, steps - 1)
    sums = sums.withColumn("s", F.sum("s").over(w)).withColumn("c", F.sum("c").over(w))
    return sums.where(F.col("c") == step * steps).select("signal_id", "block", (F.col("s") / (step * steps)).alias("ms"))
