"""Tempo and loudness of whole signals: passes of Arrow batches for what is numeric, columns of the same rows for all decisions.

Nothing crosses a shuffle: each input row gives one output row, so signals may share an id. A task holds Arrow batches of
about 4 MiB (or one longer signal), in two Python processes for tempo, and works on one signal of them at a time.

A signal that fails a guard keeps its row with null results; a file that can't be read keeps
its row with ``error``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.batches import bounded_batches, trimmed
from sigspark.operators import loudness as L
from sigspark.operators import periodicity as P
from sigspark.operators import tempo as T
from sigspark.operators.onset import envelopes
from sigspark.operators.spectral import k_weighting
from sigspark.sources.pcm import read_pcm

_ERROR = pa.struct([("code", pa.string()), ("path", pa.string()), ("detail", pa.string())])


def _transition(x: np.ndarray, rate: float) -> int:
    size = int(rate)
    count = min(S.ENERGY_WINDOWS, len(x) // size) if size else 0
    if count < 2:
        return 0
    level = np.sqrt((x[: count * size].reshape(count, size) ** 2).mean(1))
    before = np.cumsum(level)[:-1] / np.arange(1, count)
    fires = np.flatnonzero(level[1:] > S.ENERGY_FACTOR * np.maximum(before, S.SILENCE_RMS))
    return int(fires[0] + 1) * size if len(fires) else 0


def _acf(x: np.ndarray, lags: int) -> np.ndarray:
    return np.array([x[: len(x) - k] @ x[k:] for k in range(min(lags, len(x)))])


def _tempogram(x: np.ndarray, rate: float, bpms: np.ndarray | None = None) -> np.ndarray:
    bpms = np.arange(S.BPM_MIN, S.BPM_MAX + 1) if bpms is None else bpms
    x = x[: int(rate * S.TEMPOGRAM_SECONDS)]
    if not len(x):
        return np.zeros(len(bpms))
    x = x * (0.5 * (1 - np.cos(2 * np.pi * np.arange(len(x)) / len(x))))
    turns = np.outer(bpms / 60 / rate, np.arange(len(x)))
    return np.abs(np.exp(-2j * np.pi * turns) @ x)


def _acf_at(acf: np.ndarray, n: int, lags: np.ndarray) -> np.ndarray:
    """``interpolate_parabolic`` of many lags."""
    acf = np.append(acf, [0.0] * 2)
    k, low = np.floor(lags + 0.5).astype(int), np.floor(lags).astype(int)
    at = lambda i: acf[np.clip(i, 0, len(acf) - 1)]
    t = lags - k
    curve = at(k) + t * (at(k + 1) - at(k - 1)) / 2 + t * t * (at(k - 1) - 2 * at(k) + at(k + 1)) / 2
    line = np.where(low >= n, 0.0, np.where(low + 1 >= n, at(low), at(low) + (at(low + 1) - at(low)) * (lags - low)))
    return np.where((k < 1) | (k + 1 >= n), line, curve)


def _refine(bpm: float, x: np.ndarray, acf: np.ndarray, n: int, rate: float) -> float:
    """``tempo.refine``, which says what it does."""
    low, high = max(float(S.BPM_MIN), bpm - S.REFINE_SPAN), min(float(S.BPM_MAX), bpm + S.REFINE_SPAN)
    bpms = low + np.arange(int(np.floor((high - low) / S.REFINE_STEP + 0.5)) + 1) * S.REFINE_STEP
    product = np.ones(len(bpms))
    for v in (_tempogram(x, rate, bpms), _acf_at(acf, n, 60 * rate / bpms)):
        product *= v / v.max() if v.max() > 0 else 0.0
    return float(bpms[product.argmax()]) if product.max() > 0 else bpm


def _passes(samples: np.ndarray, rate: float, windows: tuple[float, ...]) -> list[dict]:
    """What the decisions need for each window. The envelope of the longest is computed once: those of the others begin it."""
    if not len(samples) or not rate or rate <= 0 or len(samples) / rate < S.MIN_SECONDS or int(rate / 100) < 1:
        return []
    start = _transition(samples, rate)
    hop, out = int(rate / 100), []
    lengths = [min(start + int(w * rate), len(samples)) - start for w in windows]
    wide = envelopes(samples[start : start + max(lengths)], rate)
    onset_rate = rate / hop
    lags = P.lags_read(onset_rate)
    for window, n in zip(windows, lengths, strict=True):
        x = samples[start : start + n]
        if n / rate < S.MIN_SECONDS or np.sqrt(np.mean(x**2)) < S.SILENCE_RMS:
            continue
        frames = (n - S.FFT_SIZE) // hop if n >= S.FFT_SIZE else 0
        e = wide[:, :frames]
        if not e.shape[1]:
            continue
        out.append({"win": window, "n": e.shape[1], "onset_rate": onset_rate, "full": e[0, : int(onset_rate * S.TEMPOGRAM_SECONDS)], "acf": _acf(e[0], lags), "acfs": [_acf(b, lags) for b in e[1:]], "tempogram": _tempogram(e[0], onset_rate)})
    return out


def _analyse(windows: tuple[float, ...], max_seconds: float | None):
    kind = pa.list_(pa.struct([("win", pa.float64()), ("n", pa.int32()), ("onset_rate", pa.float64()), ("full", pa.list_(pa.float64())), ("acf", pa.list_(pa.float64())), ("acfs", pa.list_(pa.list_(pa.float64()))), ("tempogram", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rate, samples = batch.column("sample_rate")[i].as_py(), batch.column("samples")[i].values
                x = np.zeros(0) if samples is None else np.nan_to_num(samples.to_numpy(zero_copy_only=False).astype(np.float64))
                if max_seconds is not None and rate:
                    x = x[: max(0, int(rate * max_seconds))]
                yield pa.record_batch([batch.column("signal_id").slice(i, 1), batch.column("error").slice(i, 1).cast(_ERROR), pa.array([_passes(x, rate, windows)], kind)], ["signal_id", "error", "passes"])

    return run


def _with_error(signals: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in signals.columns else F.lit(None).cast(S.ERROR)
    return signals.select("signal_id", "sample_rate", "samples", error.alias("error"))


_PASSES = "array<struct<win:double,n:int,onset_rate:double,full:array<double>,acf:array<double>,acfs:array<array<double>>,tempogram:array<double>>>"
_DECIDED = "array<struct<win:double,n:int,onset_rate:double,full:array<double>,acf:array<double>,fused:array<double>,found:array<struct<bpm:double,score:double>>,winner:double>>"


def _refiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the refined tempo of each window, as an array like ``passes``."""
    for batch in batches:
        passes = batch.column("passes")
        flat = passes.flatten()
        full, acf = flat.field("full"), flat.field("acf")
        numbers = zip(*(flat.field(k).to_pylist() for k in ("winner", "n", "onset_rate")), strict=True)
        each = [None if w is None else _refine(w, full[i].values.to_numpy(), acf[i].values.to_numpy(), n, rate) for i, (w, n, rate) in enumerate(numbers)]
        bounds = np.concatenate([[0], np.cumsum(passes.value_lengths().to_numpy(zero_copy_only=False))])
        yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(each, pa.float64()))], [*batch.schema.names, "bpms"])


@functools.cache
def _decisions(application_id: str) -> tuple[list[Column], Column]:
    """The steps from spectra to a winner, each adding a field to the windows, and the result: made once for an application, as making them takes longer than running them."""
    steps = {
        "fused": lambda p: P.fuse(p["acf"], p["n"], p["tempogram"], p["onset_rate"]),
        "enhanced": lambda p: P.enhance(p["fused"]),
        "found": lambda p: T.top_candidates(p["enhanced"]),
        "octave": lambda p: T.resolve_octave(p["found"], p["fused"], p["acfs"], p["n"], p["onset_rate"]),
        "winner": lambda p: T.confirm(p["octave"], p["acfs"], p["n"], p["onset_rate"]),
    }
    columns = [F.transform("passes", lambda p: p.withField(name, of(p))) for name, of in steps.items()]  # noqa: B023
    kept = ("win", "n", "onset_rate", "full", "acf", "fused", "found")
    columns.append(F.transform("passes", lambda p: F.struct(*[p[k].alias(k) for k in kept], p["winner"]["bpm"].alias("winner"))))

    def result(p: Column, bpm: Column) -> Column:
        ok = (F.size(p["found"]) > 0) & bpm.between(S.BPM_MIN, S.BPM_MAX)
        listed = F.transform(p["found"], lambda x: F.struct(x["bpm"].alias("bpm"), x["score"].cast("float").alias("score")))
        return F.struct(p["win"].alias("win"), F.when(ok, bpm).alias("bpm"), F.when(ok, T.confidence(p["fused"], bpm)).alias("confidence"), F.when(ok, listed).alias("candidates"))

    return columns, F.zip_with("passes", "bpms", result).alias("results")


def _windows(signals: DataFrame, windows: tuple[float, ...], max_seconds: float | None) -> DataFrame:
    """(signal_id, error, results), one row for each of ``signals``: its windows that pass the guards, as (win, bpm, confidence, candidates), whose bpm is null where no tempo was found.

    Each step is a column of its own, so that no expression is evaluated twice.
    """
    columns, results = _decisions(signals.sparkSession.sparkContext.applicationId)
    bounded_batches(signals.sparkSession)
    rows = _with_error(signals).mapInArrow(trimmed(_analyse(windows, max_seconds)), f"signal_id string, error {S.ERROR}, passes {_PASSES}")
    for passes in columns:
        rows = rows.withColumn("passes", passes)
    rows = rows.mapInArrow(trimmed(_refiner), f"signal_id string, error {S.ERROR}, passes {_DECIDED}, bpms array<double>")
    return rows.select("signal_id", "error", results)


def _checked(strategy: str) -> None:
    if strategy not in S.STRATEGIES:
        raise ValueError(f"strategy must be one of {S.STRATEGIES}")


def estimate_bpm(signals: DataFrame, window_seconds: float = 30.0, strategy: str = "subBandVoting") -> DataFrame:
    """``TEMPO_RESULT`` rows from packed signals, from one analysis window; both strategies give the same."""
    _checked(strategy)
    rows = _windows(signals, (float(window_seconds),), None).withColumn("result", F.get("results", F.lit(0)))
    return rows.select("signal_id", "result.bpm", "result.confidence", "result.candidates", "error")


def progressive(windows: DataFrame) -> DataFrame:
    """The window results that progressive analysis returns, from rows (signal_id, win, bpm, confidence, ...).

    Windows without a tempo are skipped; it stops at a confidence of 0.40 or a tempo within 2
    of the one before, and returns the highest confidence seen by then, the first of equals.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("signal_id").orderBy("win")
    rows = windows.where("bpm IS NOT NULL").withColumn("_last", F.lag("bpm").over(by))
    stop = (F.col("confidence") >= S.ENOUGH) | (F.abs(F.col("bpm") - F.col("_last")) <= S.CONVERGED)
    rows = rows.withColumn("_stop", F.min(F.when(stop, F.col("win"))).over(Window.partitionBy("signal_id"))).where("_stop IS NULL OR win <= _stop")
    rank = F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("confidence"), "win"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_last", "_stop", "_rank")


def pick(results: Column) -> Column:
    """What ``progressive`` returns, over an array of (win, bpm, confidence, candidates) in a row, in order of win."""
    first = F.struct(F.lit(False).alias("done"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("struct<bpm:double,confidence:double,candidates:array<struct<bpm:double,score:float>>>").alias("best"))

    def step(s: Column, r: Column) -> Column:
        skip = s["done"] | r["bpm"].isNull()
        better = s["best"].isNull() | (r["confidence"] > s["best"]["confidence"])
        mine = F.struct(r["bpm"].alias("bpm"), r["confidence"].alias("confidence"), r["candidates"].alias("candidates"))
        stop = (r["confidence"] >= S.ENOUGH) | F.coalesce(F.abs(r["bpm"] - s["last"]) <= S.CONVERGED, F.lit(False))
        new = F.struct(stop.alias("done"), r["bpm"].alias("last"), F.when(better, mine).otherwise(s["best"]).alias("best"))
        return F.when(skip, s).otherwise(new)

    return F.aggregate(results, first, step, lambda s: s["best"])


def analyze_bpm(signals: DataFrame, max_seconds: float | None = S.TEMPO_SECONDS, strategy: str = "subBandVoting") -> DataFrame:
    """``TEMPO_RESULT`` rows by progressive analysis over windows of 30, 60 and 90 seconds, one for each row of ``signals``."""
    _checked(strategy)
    best = _windows(signals, S.WINDOWS, max_seconds).withColumn("best", pick(F.col("results")))
    return best.select("signal_id", "best.bpm", "best.confidence", "best.candidates", "error")


def _block_sums(max_seconds: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rate, samples = batch.column("sample_rate")[i].as_py(), batch.column("samples")[i].values
                key = int(rate) if rate else 0
                blocks = None
                if samples is not None and key in S.K_WEIGHTING:
                    x = np.nan_to_num(samples.to_numpy(zero_copy_only=False).astype(np.float64))
                    x = x if max_seconds is None else x[: max(0, int(rate * max_seconds))]
                    size, step = int(rate * 0.4), int(rate * 0.1)
                    if len(x) >= size:
                        sums = np.concatenate([[0.0], np.cumsum(k_weighting(x, key) ** 2)])
                        at = np.arange((len(x) - size) // step + 1) * step
                        blocks = (sums[at + size] - sums[at]) / size
                yield pa.record_batch([batch.column("signal_id").slice(i, 1), batch.column("error").slice(i, 1).cast(_ERROR), pa.array([blocks], pa.list_(pa.float64()))], ["signal_id", "error", "blocks"])

    return run


def measure_loudness(signals: DataFrame, max_seconds: float | None = None) -> DataFrame:
    """``LOUDNESS_RESULT`` rows from packed signals at 44100, 48000 or 96000; null for other rates, short or silent signals."""
    bounded_batches(signals.sparkSession)
    rows = _with_error(signals).mapInArrow(trimmed(_block_sums(max_seconds)), f"signal_id string, error {S.ERROR}, blocks array<double>")
    rows = rows.withColumn("integrated_lufs", L.integrated(F.col("blocks")))
    answered = F.col("integrated_lufs").isNotNull()
    return rows.select("signal_id", "integrated_lufs", F.when(answered, L.block_series(F.col("blocks"))).alias("block_lufs"), F.when(answered, S.BLOCK_STEP).alias("block_step_seconds"), "error")


def analyze_bpm_files(spark: SparkSession, path: str | list[str], max_seconds: float = S.TEMPO_SECONDS, strategy: str = "subBandVoting", mode: str = "PERMISSIVE") -> DataFrame:
    """Tempo of each file; only the first ``max_seconds`` are decoded."""
    return analyze_bpm(read_pcm(spark, path, max_seconds, mode=mode), max_seconds, strategy)


def analyze_lufs_files(spark: SparkSession, path: str | list[str], max_seconds: float = S.LUFS_SECONDS, mode: str = "PERMISSIVE") -> DataFrame:
    """Integrated loudness of each file: (signal_id, integrated_lufs, error)."""
    return measure_loudness(read_pcm(spark, path, max_seconds, mode=mode), max_seconds).select("signal_id", "integrated_lufs", "error")
