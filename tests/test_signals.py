"""Known answers for signals, and operators against direct computation."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions import scalar as f
from sigspark.operators import mel, onset, periodicity, spectral, tempo, windows
from sigspark.plans import queries, service
from sigspark.sources import pcm, synth, wav
from sigspark.sources.resample import resample


def click(bpm, rate=44100, seconds=15):
    k = np.arange(int(rate * seconds)) % int(rate * 60 / bpm)
    return np.where(k < 64, np.exp(-k / 10), 0.0)


def tone(hz, rate, seconds, level):
    return 10 ** (level / 20) * 2**0.5 * np.sin(2 * np.pi * hz / rate * np.arange(int(rate * seconds)))


def signals(spark, named):
    rows = [(n, float(r), [float(v) for v in np.asarray(x, np.float32)]) for n, (x, r) in named.items()]
    return spark.createDataFrame(rows, S.SIGNAL_PACKED)


def test_range_normalize(spark):
    rows = [(40.0, 80.0), (210.0, 105.0), (60.0, 60.0), (200.0, 200.0), (30.0, 60.0), (400.0, 200.0), (0.0, None), (-5.0, None)]
    got = spark.createDataFrame(rows, "b double, want double").select(f.range_normalize(F.col("b")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_mel_and_small_functions(spark):
    r = spark.range(1).select(
        f.mel_to_hz(f.hz_to_mel(F.lit(440.0))).alias("hz"), f.hz_to_mel(F.lit(0.0)).alias("zero"), f.floor_lufs(F.lit(None).cast("double")).alias("floor"),
        *[f.next_power_of_two(F.lit(n)).alias(f"p{n}") for n in (0, 1, 2, 3, 8, 9)],
    ).first()
    assert abs(r.hz - 440) < 0.01 and r.zero == 0 and r.floor == -100
    assert [r[f"p{n}"] for n in (0, 1, 2, 3, 8, 9)] == [1, 1, 2, 4, 8, 16]


def test_interpolation_rounds_halves_away(spark):
    a = F.array(*[F.lit(float(v)) for v in (1, 5, 2, 8, 3)])
    r = spark.range(1).select(f.interpolate_parabolic(a, F.lit(5), F.lit(1.5)).alias("p"), f.interpolate_linear(a, F.lit(5), F.lit(3.5)).alias("l"), f.interpolate_linear(a, F.lit(5), F.lit(4.5)).alias("end"), f.interpolate_linear(a, F.lit(5), F.lit(7.0)).alias("out")).first()
    t = -0.5
    assert abs(r.p - (2 + t * (8 - 5) / 2 + t * t * (5 - 4 + 8) / 2)) < 1e-12
    assert (r.l, r.end, r.out) == (5.5, 3.0, 0.0)


@pytest.fixture(scope="module")
def tempos(spark):
    named = {f"click{b}": (click(b), 44100) for b in (80, 85, 120, 140, 160, 170)}
    named |= {"48k": (click(120, 48000), 48000), "intro": (np.concatenate([np.zeros(441000), click(120, seconds=30)]), 44100)}
    named |= {"zeros": (np.zeros(441000), 44100), "short": (click(120, seconds=0.5), 44100), "empty": (np.zeros(0), 44100)}
    named["noise"] = (synth.splitmix64(42, 441000).astype(float) / (2**64 - 1) * 2 - 1, 44100)
    return {r.signal_id: r for r in service.estimate_bpm(signals(spark, named)).collect()}


@pytest.mark.parametrize("name,bpm", [("click80", 80), ("click85", 85), ("click120", 120), ("click140", 140), ("click160", 160), ("click170", 170), ("48k", 120), ("intro", 120)])
def test_click_tempo(tempos, name, bpm):
    assert abs(tempos[name].bpm - bpm) <= 2
    assert tempos[name].confidence > 0.5 and tempos[name].candidates


def test_no_tempo(tempos):
    assert all(tempos[n].bpm is None and tempos[n].candidates is None for n in ("zeros", "short", "empty"))
    assert tempos["noise"].bpm is None or tempos["noise"].confidence < 0.5


def test_progressive_equals_first_window_of_a_short_signal(spark, tempos):
    r = service.analyze_bpm(signals(spark, {"a": (click(120), 44100), "z": (np.zeros(441000), 44100)})).orderBy("signal_id").collect()
    assert r[0].bpm == tempos["click120"].bpm and r[1].bpm is None
    with pytest.raises(ValueError):
        service.analyze_bpm(signals(spark, {"a": (click(120), 44100)}), strategy="other")


def test_progressive_rules(spark):
    rows = [("a", 30.0, 100.0, 0.1), ("a", 60.0, 101.0, 0.2), ("a", 90.0, 150.0, 0.9), ("b", 30.0, 100.0, 0.3), ("b", 60.0, None, None), ("b", 90.0, 150.0, 0.2), ("c", 30.0, 90.0, 0.4), ("c", 60.0, 180.0, 0.9)]
    df = spark.createDataFrame(rows, "signal_id string, win double, bpm double, confidence double")
    got = {r.signal_id: (r.win, r.bpm) for r in service.progressive(df).collect()}
    assert got == {"a": (60.0, 101.0), "b": (30.0, 100.0), "c": (30.0, 90.0)}


def test_loudness(spark):
    named = {f"{r}{level}": (tone(997, r, 10, level), r) for r in (44100, 48000, 96000) for level in (-23, -14)}
    named |= {"30": (tone(30, 48000, 5, -20), 48000), "997": (tone(997, 48000, 5, -20), 48000), "100": (tone(100, 48000, 5, -20), 48000), "3k": (tone(3000, 48000, 5, -20), 48000)}
    named |= {"dc": (tone(997, 48000, 5, -20) + 0.1, 48000), "22k": (tone(997, 22050, 5, -20), 22050), "zeros": (np.zeros(480000), 48000), "short": (tone(997, 48000, 0.2, -20), 48000), "empty": (np.zeros(0), 48000)}
    loud = tone(997, 48000, 5, -14)
    named["gated"] = (np.concatenate([loud, np.zeros(240000), loud]), 48000)
    got = {r.signal_id: r for r in service.measure_loudness(signals(spark, named)).collect()}
    for level in (-23, -14):
        assert abs(got[f"48000{level}"].integrated_lufs - level) < 0.01
        assert abs(got[f"44100{level}"].integrated_lufs - level + 0.001) < 0.01
        assert abs(got[f"96000{level}"].integrated_lufs - level + 0.477) < 0.01
    assert got["997"].integrated_lufs - got["30"].integrated_lufs > 8 and got["3k"].integrated_lufs > got["100"].integrated_lufs
    assert abs(got["dc"].integrated_lufs - got["997"].integrated_lufs) < 0.5
    assert abs(got["gated"].integrated_lufs + 14) < 1
    assert all(got[n].integrated_lufs is None and got[n].block_lufs is None for n in ("22k", "zeros", "short", "empty"))
    assert len(got["997"].block_lufs) == (240000 - 19200) // 4800 + 1 and got["997"].block_step_seconds == 0.1


def test_loud_quiet_loud(spark):
    blocks = service.measure_loudness(synth.packed(synth.sine_sections(spark, 997, 48000, 2, [-14, -80, -14]), "lql", 48000)).first().block_lufs
    third = len(blocks) // 3
    loud, quiet = np.mean(blocks[: third - 4] + blocks[-third + 4 :]), np.mean(blocks[third + 4 : -third - 4])
    assert loud > quiet + 10


def test_k_weighting_is_the_recursion(spark):
    x = np.random.RandomState(1).randn(50_000)
    for rate, sections in S.K_WEIGHTING.items():
        y = x[:3000]
        for s in sections:
            y = spectral._biquad(*s, y)
        assert np.allclose(spectral.k_weighting(x, rate)[:3000], y, atol=1e-9)
    short = spark.createDataFrame([(x[:40].tolist(),)], "x array<double>").select(spectral.k_weighting_column(F.col("x"), 48000).alias("y")).first().y
    assert np.allclose(short, spectral.k_weighting(x[:40], 48000), atol=1e-12)


def test_filterbank(spark):
    for rate in (44100.0, 96000.0):
        m = np.zeros((128, 1024))
        for r in mel.filterbank(spark, rate).collect():
            m[r.band, r.bin] = r.weight
        assert np.allclose(m, mel.filterbank_matrix(rate))
        dead = np.flatnonzero(m.sum(1) == 0).tolist()
        assert dead == ([] if rate == 44100 else [1, 6])
        for row in m[m.sum(1) > 0]:
            at = np.flatnonzero(row)
            assert at[-1] - at[0] + 1 == len(at)


def test_envelopes(spark):
    for bpm in (120, 160):
        e = onset.envelopes(click(bpm), 44100)
        assert e.shape == (5, (len(click(bpm)) - 2048) // 441) and (e.max(1) > 0).all()
        assert 118 <= 40 + service._tempogram(onset.envelopes(click(120), 44100)[0], 100).argmax() <= 122
    x = np.random.RandomState(0).randn(2048 + 441 * 3)
    got = np.vstack(list(spectral.frame_powers(x, 441)))
    direct = np.abs(2 * np.fft.fft(x[441 : 441 + 2048] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048)))) ** 2
    assert np.allclose(got[1, 1:], direct[1:1024]) and np.allclose(got[1, 0], direct[0] + direct[1024])


def test_fusion_and_vote(spark):
    acf = np.zeros(153)
    acf[[37, 75]] = 1.0, 0.9
    tg = np.zeros(211)
    tg[[120, 210]] = 1.0, 0.8
    bands = [(75, 1.0, 37, 0.2), (75, 1.0, 37, 0.3), (75, 0.2, 37, 1.0), (75, 0.1, 37, 1.0)]
    acfs = []
    for a, x, b, y in bands:
        v = np.zeros(153)
        v[[a, b]] = x, y
        acfs.append(v.tolist())
    df = spark.createDataFrame([(acf.tolist(), tg.tolist(), acfs)], "acf array<double>, tg array<double>, acfs array<array<double>>")
    r = df.select(periodicity.fuse(F.col("acf"), F.lit(2000), F.col("tg"), F.lit(100.0)).alias("fused"), tempo.vote_is_fast(F.col("acfs"), F.lit(2000), F.lit(160.0), F.lit(80.0), F.lit(100.0)).alias("fast")).first()
    assert abs(40 + int(np.argmax(r.fused)) - 160) <= 2 and r.fused[40] < 0.5 * r.fused[120] and r.fast


def test_treble_truth_table():
    """With the hi-hat for the faster tempo, the vote is for it exactly if a snare band is."""
    for bits in range(8):
        kick, low, crack = (bits >> i & 1 for i in range(3))
        vote = sum(w if v else -w for v, w in zip((kick, low, crack, 1), S.BAND_WEIGHTS, strict=True)) > 0
        assert vote == bool(low or crack)


def test_native_periodicity_equals_vectorised(spark):
    x = np.abs(np.random.RandomState(2).randn(900))
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    df = df.select(periodicity.autocorrelation(F.col("x")).alias("acf"), periodicity.fourier_magnitudes(periodicity.windowed_prefix(F.col("x"), F.lit(100.0)), F.lit(100.0), periodicity.grid()).alias("tg"))
    r = df.first()
    assert np.allclose(r.acf, service._acf(x, periodicity.lags_read(100.0))) and np.allclose(r.tg, service._tempogram(x, 100.0))


def test_energy_transition(spark):
    x = np.concatenate([np.full(24, 0.1), np.full(16, 1.0), np.zeros(5)])
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 1.0) for i in range(10)]
    got = dict(map(tuple, windows.energy_transition(spark.createDataFrame(rows, "signal_id string, idx long, value double"), 8).collect()))
    assert got == {"a": 24, "b": 0} and service._transition(np.repeat(x, 100), 800) == 2400


def test_wav_and_aiff(spark, tmp_path):
    import struct

    x = click(120, seconds=10)
    (tmp_path / "a.wav").write_bytes(wav.wav_bytes(x, 44100, extra=b"bext" + struct.pack("<I", 6) + b"abcdef"))
    (tmp_path / "four.wav").write_bytes(wav.wav_bytes(np.vstack([x, x * 0, x, x * 0]), 44100))
    (tmp_path / "none.wav").write_bytes(wav.wav_bytes(np.zeros(0), 44100))
    (tmp_path / "bad.wav").write_bytes(b"\x89PNG\r\n\x1a\n")
    pcm16 = (np.array([0.5, -0.5]) * 32768).astype(">i2").tobytes()
    comm = struct.pack(">hIhHQ", 1, 2, 16, 16383 + 15, 44100 << 48)
    body = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", 8 + len(pcm16), 0, 0) + pcm16
    (tmp_path / "b.aiff").write_bytes(b"FORM" + struct.pack(">I", 4 + len(body)) + b"AIFF" + body)
    pcm.register(spark)
    for df in (pcm.read_pcm(spark, str(tmp_path)), spark.read.format("pcm").option("path", f"{tmp_path}/*").load()):
        got = {r.signal_id.rpartition("/")[2]: r for r in df.collect()}
        assert len(got["a.wav"].samples) == 441000 and got["a.wav"].sample_rate == 44100
        assert np.allclose(got["four.wav"].samples, x / 2, atol=1e-6)
        assert got["none.wav"].samples == [] and got["none.wav"].sample_rate == 44100
        assert got["bad.wav"].error.code == "fileNotReadable" and got["bad.wav"].samples is None
        assert got["b.aiff"].samples == [0.5, -0.5] and got["b.aiff"].sample_rate == 44100
    part = spark.read.format("pcm").option("path", f"{tmp_path}/a.wav").option("maxSeconds", "1").option("targetSampleRate", "22050").load().first()
    assert abs(len(part.samples) - 22050) < 2205 and part.sample_rate == 22050
    missing = spark.read.format("pcm").option("path", f"{tmp_path}/no.wav").load().first()
    assert missing.error.code == "fileNotReadable"
    with pytest.raises(Exception, match="fileNotReadable"):
        pcm.read_pcm(spark, f"{tmp_path}/bad.wav", mode="FAILFAST").collect()
    found = {r.signal_id.rpartition("/")[2]: r for r in service.analyze_bpm_files(spark, str(tmp_path)).collect()}
    assert abs(found["a.wav"].bpm - 120) <= 2 and found["a.wav"].confidence > 0.3 and found["bad.wav"].error.code == "fileNotReadable"
    assert service.analyze_lufs_files(spark, f"{tmp_path}/a.wav").count() == 1


def test_resample():
    x = tone(440, 44100, 1, -3)
    for target in (4410, 22050, 48000):
        y = resample(x, 44100, target)
        assert len(y) == round(44100 * target / 44100)
        want = tone(440, target, 1, -3)
        assert np.abs(y - want)[200:-200].max() < 0.02
    with pytest.raises(pcm.PcmError, match="conversionFailed"):
        pcm.decode(wav.wav_bytes(x, 44100), target_rate=0)


def test_splitmix_and_packed(spark):
    assert synth.splitmix64(42, 5, 3).tolist() == synth.splitmix64(42, 8).tolist()[3:]
    a = synth.packed(synth.click_track(spark, 120, 8000, 1), "a", 8000)
    assert np.allclose(a.first().samples, click(120, 8000, 1), atol=1e-6)
    assert a.collect() == synth.generated(spark, "a", 8000, 1, lambda i: synth.click(i, 120, 8000)).collect()
    b = synth.generated(spark, "b", 8000, 1, lambda i: synth.wave(i, 440, 8000, -20, 0.1))
    assert b.collect() == synth.packed(synth.sine(spark, 440, 8000, 1, -20, 0.1), "b", 8000).collect()


def test_streaming_equals_batch(spark, tmp_path):
    from sigspark.streaming.momentary import momentary_loudness

    rows = spark.range(100).select((F.col("id") % 3).alias("signal_id"), F.timestamp_millis(F.col("id") * 37).alias("ts"), (F.col("id") * 0.01).alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = momentary_loudness(stream).writeStream.outputMode("complete").format("memory").queryName("momentary").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.signal_id, r.start)
    assert sorted(spark.table("momentary").collect(), key=key) == sorted(momentary_loudness(rows).collect(), key=key)


def test_confidence_takes_the_unrounded_tempo(spark):
    """250 is an octave of 120.4 (2.076), but not of 120 (2.083)."""
    fused = np.full(211, 0.01)
    fused[[80, 210]] = 1.0, 0.9
    r = spark.createDataFrame([(fused.tolist(),)], "f array<double>").select(*[tempo.confidence(F.col("f"), F.lit(b)).alias(n) for b, n in ((120.4, "part"), (120.0, "whole"))]).first()
    par = 1 / fused.mean()
    want = lambda clarity: 1 - np.exp(-5 * (min(1, (par - 1) / 10) + min(1, max(0, (clarity - 1) / 5))) / 2)
    assert abs(r.part - want(100)) < 1e-9 and abs(r.whole - want(1 / 0.9)) < 1e-9


def test_octave_without_four_bands(spark):
    rows = [([(80.0, 1.0), (160.0, 0.1)], []), ([(80.0, 1.0), (160.0, 0.6)], []), ([(80.0, 1.0), (160.0, 0.6)], [[1.0] * 160] * 3)]
    df = spark.createDataFrame([(c, [0.5] * 211, a) for c, a in rows], "c array<struct<bpm:double,score:double>>, f array<double>, a array<array<double>>")
    got = [r.w.bpm for r in df.select(tempo.resolve_octave(F.col("c"), F.col("f"), F.col("a"), F.lit(900), F.lit(100.0)).alias("w")).collect()]
    assert got == [80.0, 160.0, 160.0]


def test_signals_that_share_an_id(spark):
    rows = [("a", 44100.0, [float(v) for v in click(b)]) for b in (120, 85)] + [(None, 44100.0, None)] * 2
    got = service.analyze_bpm(spark.createDataFrame(rows, S.SIGNAL_PACKED)).collect()
    assert sorted(round(r.bpm) for r in got if r.bpm) == [85, 120] and len(got) == 4


def test_refinement_twins(spark):
    r = np.random.RandomState(4)
    rows = []
    for n, rate, bpm in ((900, 100.0, 120.0), (700, 100.0, 42.0), (300, 128.0, 250.0), (120, 125.0, 60.0), (40, 100.0, 100.0)):
        x = np.maximum(0, r.randn(n)) * 2 + (np.arange(n) % 41 == 0) * 5
        rows.append((x.tolist(), service._acf(x, periodicity.lags_read(rate)).tolist(), n, rate, bpm))
    df = spark.createDataFrame(rows, "x array<double>, acf array<double>, n int, rate double, bpm double")
    got = df.select(tempo.refine(F.col("bpm"), periodicity.windowed_prefix(F.col("x"), F.col("rate")), F.col("acf"), F.col("n"), F.col("rate")).alias("b")).collect()
    want = [service._refine(b, np.array(x), np.array(a), n, rate) for x, a, n, rate, b in rows]
    assert np.allclose([g.b for g in got], want)


def test_progressive_twins(spark):
    r = np.random.RandomState(7)
    rows = [(str(i), 30.0 * w, None if r.rand() < 0.2 else float(r.randint(100, 106)), float(r.randint(0, 6)) / 10) for i in range(300) for w in (1, 2, 3)]
    df = spark.createDataFrame(rows, "signal_id string, win double, bpm double, confidence double")
    df = df.withColumn("confidence", F.when(F.col("bpm").isNotNull(), F.col("confidence")))
    want = {r.signal_id: (r.bpm, r.confidence) for r in service.progressive(df).collect()}
    none = F.array().cast("array<struct<bpm:double,score:float>>").alias("candidates")
    packed = df.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("win", "bpm", "confidence"))).alias("r"))
    got = packed.select("signal_id", service.pick(F.transform("r", lambda w: F.struct(w["win"].alias("win"), w["bpm"].alias("bpm"), w["confidence"].alias("confidence"), none))).alias("b")).collect()
    assert {g.signal_id: (g.b.bpm, g.b.confidence) for g in got if g.b is not None} == want and len(want) > 250


def test_numeric_twins(spark):
    """What runs in Arrow batches equals the columns and rows that SQL checks."""
    r = np.random.RandomState(5)
    x = np.concatenate([r.randn(8, 40) * 0.1, r.randn(8, 30)], 1)
    long = spark.createDataFrame([(i, j, float(v)) for i, s in enumerate(x) for j, v in enumerate(s)], "signal_id long, idx long, value double")
    starts = {q.signal_id: q.start for q in windows.energy_transition(long, 8).collect()}
    assert [starts[i] for i in range(8)] == [service._transition(s, 8.0) for s in x]
    ms = {}
    for q in windows.block_mean_squares(long, 4).collect():
        ms.setdefault(q.signal_id, {})[q.block] = q.ms
    for i, s in enumerate(x):
        sums = np.concatenate([[0], np.cumsum(s**2)])
        assert np.allclose([ms[i][b] for b in sorted(ms[i])], [(sums[4 * b + 16] - sums[4 * b]) / 16 for b in range((len(s) - 16) // 4 + 1)])
    acf = service._acf(x[0], 60)
    lags = np.array([0.2, 1.0, 1.5, 7.3, 58.2, 59.0, 59.5, 61.0, 80.0])
    df = spark.createDataFrame([(acf.tolist(), float(v)) for v in lags], "a array<double>, lag double")
    got = [q.v for q in df.select(f.interpolate_parabolic(F.col("a"), F.lit(60), F.col("lag")).alias("v")).collect()]
    assert np.allclose(got, service._acf_at(acf, 60, lags))


def test_onset_twins(spark):
    """The production kernel against frames, spectrum, bank and flux as rows, at the full size."""
    rate, n = 44100.0, 2048 + 441 * 2
    x = click(240, rate, 1)[:n] + 0.01 * np.random.RandomState(1).randn(n)
    long = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "signal_id long, idx long, value double")
    spectrum = spectral.power_spectrum(windows.frames(long, 2048, 441), 2048)
    got = onset.onset_long(mel.project(spectrum, mel.filterbank(spark, rate)), S.BANDS).orderBy("frame").collect()
    want = onset.envelopes(x, rate)
    assert len(got) == want.shape[1] == 2
    assert np.allclose([[g[c] for g in got] for c in ("full", *S.BANDS)], want, rtol=1e-6)


def _tasks_and_rows(df):
    counted = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return len(counted), max(r["count"] for r in counted)


@pytest.fixture
def many_vectors(spark, tmp_path, monkeypatch):
    """1000 embeddings, where a task is to get the samples of 50."""
    monkeypatch.setattr(windows, "SPREAD", 50 * 64, raising=False)
    spark.range(1000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_onset_flux_tasks_are_bounded(spark, many_vectors):
    """More signals make more tasks, not larger ones, whatever the number of shuffle partitions (4 here)."""
    tasks, rows = _tasks_and_rows(queries.onset_flux(spark, many_vectors))
    assert tasks >= 19 and rows <= 100 * 12


def test_onset_subbands_tasks_are_bounded(spark, many_vectors):
    """The same with sums by band, and every signal is there."""
    got = queries.onset_subbands(spark, many_vectors)
    tasks, rows = _tasks_and_rows(got)
    assert tasks >= 19 and rows <= 100 * 12
    assert got.count() == 1000 * 12 and got.select("signal_id").distinct().count() == 1000


def test_onset_rates_of_slow_signals(spark):
    """At 250 samples a second the slowest tempo needs a lag of 188."""
    rate = 250.0
    x = np.random.RandomState(6).randn(int(rate * 40)) * (np.arange(int(rate * 40)) % 312 < 30)
    assert periodicity.lags_read(125.0) == 190
    r = service.estimate_bpm(signals(spark, {"slow": (x, rate)})).first()
    assert r.bpm is not None and 0 <= r.confidence <= 1


@pytest.mark.parametrize("pass_name,analyse", [("_analyse", service.estimate_bpm), ("_block_sums", service.measure_loudness)])
def test_batches_are_bounded(spark, monkeypatch, pass_name, analyse):
    """Processes hold batches, so these don't grow with a task's signals: here 24 MB lie in one partition."""

    def spy(*_):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                rest = [pa.nulls(1, service._ERROR), pa.nulls(1, pa.list_(pa.float64()))]
                yield pa.record_batch([pa.array([str(b.nbytes)]), *rest], ["signal_id", "error", "blocks"])

        return run

    def no_windows(*_):
        def run(batches):
            import pyarrow as pa

            for b in spy()(batches):
                kind = pa.struct([("win", pa.float64()), ("n", pa.int32()), ("onset_rate", pa.float64()), *((k, pa.list_(pa.float64())) for k in ("full", "acf")), ("acfs", pa.list_(pa.list_(pa.float64()))), ("tempogram", pa.list_(pa.float64()))])
                yield pa.record_batch([b.column(0), b.column(1), pa.array([[]], pa.list_(kind))], ["signal_id", "error", "passes"])

        return run

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    try:
        monkeypatch.setattr(service, pass_name, no_windows if pass_name == "_analyse" else spy)
        many = spark.range(0, 600, 1, 1).select(F.col("id").cast("string").alias("signal_id"), F.lit(1000.0).alias("sample_rate"), F.array_repeat(F.lit(0.5).cast("float"), 10_000).alias("samples"))
        sizes = [int(r.signal_id) for r in analyse(many).select("signal_id").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) > 20e6 and max(sizes) < 6e6


def test_sql_functions(spark):
    f.register(spark)
    rows = spark.range(30).select(((F.col("id") - 3) * 21.7).alias("b"), (F.col("id") / 4).alias("lag"), F.array(*[F.lit(float(v)) for v in (1, 5, 2, 8, 3)]).alias("a"))
    same = rows.select(
        F.expr("range_normalize(b)").eqNullSafe(f.range_normalize(F.col("b"))).alias("x"),
        F.expr("interpolate_linear(a, 5, lag)").eqNullSafe(f.interpolate_linear(F.col("a"), F.lit(5), F.col("lag"))).alias("y"),
        F.expr("interpolate_parabolic(a, 5, lag)").eqNullSafe(f.interpolate_parabolic(F.col("a"), F.lit(5), F.col("lag"))).alias("z"),
    )
    assert same.where("x AND y AND z").count() == 30


def test_malformed_files(spark, tmp_path):
    import struct

    def riff(*chunks, kind=b"RIFF", order="<"):
        body = b"".join(n + struct.pack(f"{order}I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
        return kind + struct.pack(f"{order}I", 4 + len(body)) + b"WAVE" + body

    def form(tag=1, channels=1, rate=8000, bits=16):
        return b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, 0, 0, bits)

    data = (b"data", bytes(64))
    bad = {
        "zero_bits": riff(form(bits=0), data), "float24": riff(form(3, bits=24), data), "int40": riff(form(bits=40), data), "int64": riff(form(bits=64), data),
        "no_channels": riff(form(channels=0), data), "no_rate": riff(form(rate=0), data), "alaw": riff(form(6, bits=8), data), "no_fmt": riff(data), "late_fmt": riff(data, form()),
        "no_data": riff(form()), "short_fmt": riff((b"fmt ", b"abc"), data), "empty": b"", "head": b"RIFF\0\0\0\0WAVE", "big_no_fmt": riff((b"LIST", bytes(2 << 20)), data),
        "extensible": riff((b"fmt ", form(0xFFFE)[1]), data), "aiff": b"FORM\0\0\0\0AIFFCOMM\0\0\0\x02ab", "flac": b"fLaC" + bytes(60), "flac_head": b"fLaC\x80\0\0\x22" + bytes(20), "mp3": b"ID3" + bytes(99),
    }
    for name, content in bad.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    x = np.random.RandomState(0).randint(-(2**15), 2**15, 16000).astype("<i2")
    good = {
        "list": riff(form(), (b"LIST", b"data" * (3 << 18)), (b"data", x.tobytes())),
        "long": riff(form(), (b"ds64", struct.pack("<QQQ", 0, 32000, 16000)), (b"data", x.tobytes()), kind=b"RF64").replace(b"data" + struct.pack("<I", 32000), b"data" + b"\xff" * 4),
        "cut": riff(form(), (b"data", x.tobytes()))[:-1000],
        "wide": riff(form(3, 24, bits=64), (b"data", np.repeat(x[:900] / 32768, 24).astype("<f8").tobytes())),
    }
    (tmp_path / "good").mkdir()
    for name, content in good.items():
        (tmp_path / "good" / f"{name}.wav").write_bytes(content)
    pcm.register(spark)
    spark.read.format("pcm").option("path", str(tmp_path))
    for most in (None, 1.0):
        source = spark.read.format("pcm").option("path", str(tmp_path))
        for df in (pcm.read_pcm(spark, f"{tmp_path}/*.wav", most), (source.option("maxSeconds", most) if most else source).load()):
            got = df.collect()
            assert len(got) in (len(bad) - 1, len(bad)) and {r.error.code for r in got if r.error} == {"fileNotReadable"} and all(r.error for r in got)
        source = spark.read.format("pcm").option("path", f"{tmp_path}/good")
        for df in (pcm.read_pcm(spark, f"{tmp_path}/good", most), (source.option("maxSeconds", most) if most else source).load()):
            got = {r.signal_id.rpartition("/")[2]: r for r in df.collect()}
            for name, n in (("list", 16000), ("long", 16000), ("cut", 15500)):
                n = min(n, 8000) if most else n
                assert got[f"{name}.wav"].error is None and np.allclose(got[f"{name}.wav"].samples, x[:n] / 32768)
            assert np.allclose(got["wide.wav"].samples, x[:900] / 32768, atol=1e-6)
    found = service.analyze_bpm_files(spark, f"{tmp_path}/*.wav").collect()
    assert len(found) == len(bad) - 1 and all(r.error and r.bpm is None for r in found)


def test_only_a_prefix_is_read():
    import io

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            out = super().read(n)
            self.seen += len(out)
            return out

    f = Counted(wav.wav_bytes(np.zeros((2, 400_000)), 44100, extra=b"LIST\0\0\x10\0" + bytes(1 << 20)))
    assert len(pcm.decode(f, max_seconds=1.0)[0]) == 44100 and f.seen < 44100 * 8 + 200


def test_registered_decoders_reach_the_executors(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"RAW1" + np.arange(4, dtype="<f4").tobytes())
    before = list(pcm._decoders)
    pcm.register_decoder(lambda d: d[:4] == b"RAW1", lambda d, most: (np.frombuffer(d[4:], "<f4")[None], 10.0))
    pcm.register(spark)
    try:
        frames = [pcm.read_pcm(spark, str(tmp_path)), spark.read.format("pcm").option("path", str(tmp_path)).load()]
        samples = [f.first().samples for f in frames]
    finally:
        pcm._decoders[:] = before
    assert samples == [[0.0, 1.0, 2.0, 3.0]] * 2
