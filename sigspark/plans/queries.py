"""Queries over the driver's tables that show each operator, with the SQL they must equal.

Signals are read from the tables as follows. E: each embedding is a signal of 64 samples.
V: the values of each user's events, in order of time. H: events counted by hour, one hour as
a frame at a rate of 100. D: lineitems counted by day of shipping, likewise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions import scalar as f
from sigspark.operators import channels, loudness, mel, onset, periodicity, spectral, tempo, windows
from sigspark.plans import service
from sigspark.sources import pcm, synth, wav
from sigspark.sources.resample import resample

QUERIES: dict = {}
SQL: dict[str, str] = {}
RATE = 100.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.explode_signal(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), "embedding"), "embedding")


def v_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "value")


def counts(df: DataFrame, at: Column) -> DataFrame:
    """One row (n, x): counts by whole step of time from the first on, 0 where there are none. Its length is the span of time."""
    by = df.select(at.cast("long").alias("t")).groupBy("t").count()
    seen = by.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.map_from_entries(F.collect_list(F.struct("t", F.col("count").cast("double")))).alias("m"))
    x = F.transform(F.sequence("a", "b"), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0)))
    return seen.select(x.alias("x")).select("x", F.size("x").alias("n"))


def h_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "events"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))


def d_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "lineitem"), F.datediff("l_shipdate", F.lit("1970-01-01")))


def chain(series: DataFrame) -> DataFrame:
    """One row with each array of the tempo analysis as a column of its own."""
    rate = F.lit(RATE)
    df = series.withColumn("acf", periodicity.autocorrelation(F.col("x")))
    df = df.withColumn("windowed", periodicity.windowed_prefix(F.col("x"), rate))
    df = df.withColumn("tempogram", periodicity.fourier_magnitudes(F.col("windowed"), rate, periodicity.grid()))
    df = df.withColumn("fused", periodicity.fuse(F.col("acf"), F.col("n"), F.col("tempogram"), rate))
    df = df.withColumn("enhanced", periodicity.enhance(F.col("fused")))
    return df.withColumn("found", tempo.top_candidates(F.col("enhanced")))


def on_grid(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.posexplode(column).alias("i", "v")).select((F.col("i") + S.BPM_MIN).cast("long").alias("bpm"), r6(F.col("v")).alias("v"))


_E = "e AS (SELECT vec_id AS signal_id, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_V = "v AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events)"
_EHOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"
_H = f"c AS (SELECT {_EHOUR} AS t, count(*) AS c FROM events GROUP BY 1)"
_D = "c AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, count(*) AS c FROM lineitem GROUP BY 1)"
_SERIES = """s AS (SELECT g.t - (SELECT min(t) FROM c) AS i, CAST(coalesce(c.c, 0) AS DOUBLE) AS x
  FROM (SELECT unnest(range((SELECT min(t) FROM c), (SELECT max(t) FROM c) + 1)) AS t) g LEFT JOIN c ON c.t = g.t),
z AS (SELECT count(*) AS n, least(count(*), 800) AS m FROM s)"""
_ACF = "acf AS (SELECT k, sum(a.x * b.x) AS r FROM (SELECT unnest(range(153)) AS k) l JOIN s a ON true JOIN s b ON b.i = a.i + k GROUP BY k)"
_GRID = "g AS (SELECT unnest(range(40, 251)) AS bpm)"
_TEMPO = """w AS (SELECT i, x * 0.5 * (1 - cos(2 * pi() * i / m)) AS x FROM s, z WHERE i < m),
tg AS (SELECT bpm, sqrt(power(sum(x * cos(2 * pi() * bpm / 60 / 100 * i)), 2) + power(sum(x * sin(2 * pi() * bpm / 60 / 100 * i)), 2)) AS v FROM g, w GROUP BY bpm)"""


def _parabolic(grid: str, name: str) -> str:
    return f"""{name} AS (SELECT bpm, b.r + t * (c.r - a.r) / 2 + t * t * (a.r - 2 * b.r + c.r) / 2 AS v
  FROM (SELECT bpm, CAST(floor(6000.0::DOUBLE / bpm + 0.5) AS BIGINT) AS k, 6000.0::DOUBLE / bpm - floor(6000.0::DOUBLE / bpm + 0.5) AS t FROM {grid}) q
  JOIN acf a ON a.k = q.k - 1 JOIN acf b ON b.k = q.k JOIN acf c ON c.k = q.k + 1)"""


_FUSED = """fu AS (SELECT bpm, CASE WHEN max(ab.v) OVER () > 0 THEN ab.v / max(ab.v) OVER () ELSE ab.v END * CASE WHEN max(tg.v) OVER () > 0 THEN tg.v / max(tg.v) OVER () ELSE tg.v END AS v
  FROM ab JOIN tg USING (bpm)),
en AS (SELECT f.bpm, f.v + 0.5 * coalesce(h.v, 0) + 0.25 * coalesce(l.v, 0) + 0.25 * coalesce(u.v, 0) AS v
  FROM fu f LEFT JOIN fu h ON h.bpm = f.bpm // 2 LEFT JOIN fu l ON l.bpm = f.bpm // 2 - 1 LEFT JOIN fu u ON u.bpm = f.bpm // 2 + 1)"""
_NORMAL = "CASE WHEN b < 60 THEN b * 2 ELSE CASE WHEN b > 200 THEN b / 2 ELSE b END END"
_TOP = f"""pk AS (SELECT bpm, v, lag(v) OVER (ORDER BY bpm) AS p, lead(v) OVER (ORDER BY bpm) AS q FROM en),
ca AS (SELECT row_number() OVER (ORDER BY v DESC, CASE bpm WHEN 40 THEN 1 WHEN 250 THEN 2 ELSE 0 END, bpm) AS rank, {_NORMAL} AS bpm, v AS score
  FROM (SELECT *, CAST(bpm AS DOUBLE) AS b FROM pk) WHERE (p IS NULL OR v > p) AND (q IS NULL OR v > q) QUALIFY rank <= 3)"""


def _chain_sql(counts_sql: str) -> str:
    return ",\n".join([counts_sql, _SERIES, _ACF, _GRID, _TEMPO, _parabolic("g", "ab"), _FUSED, _TOP])


# Scalar functions.


@query("SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) + 0.0 AS mel, round(700 * (pow(10, p_retailprice / 2595) - 1), 6) + 0.0 AS hz FROM part")
def mel_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(f.hz_to_mel(F.col("p_retailprice"))).alias("mel"), r6(f.mel_to_hz(F.col("p_retailprice"))).alias("hz"))


@query("SELECT p_partkey, round(p_retailprice, 6) + 0.0 AS hz FROM part")
def mel_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(f.mel_to_hz(f.hz_to_mel(F.col("p_retailprice")))).alias("hz"))


@query("""SELECT event_id, round(CASE WHEN value <= 0 THEN NULL
  WHEN value < 60 THEN (SELECT min(value * pow(2, k)) FROM range(0, 60) t(k) WHERE value * pow(2, k) >= 60)
  WHEN value > 200 THEN (SELECT max(value / pow(2, k)) FROM range(0, 60) t(k) WHERE value / pow(2, k) <= 200) ELSE value END, 6) + 0.0 AS bpm FROM events""")
def range_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(f.range_normalize(F.col("value"))).alias("bpm"))


@query("""SELECT p_partkey, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS power_of_two, round(6000.0 / p_size, 6) + 0.0 AS lag,
  round(-0.691 + 10 * log10(p_retailprice / 1000), 6) + 0.0 AS lufs, round(ln(1 + 100 * p_retailprice), 6) + 0.0 AS compressed,
  round(0.5 * (1 - cos(2 * pi() * p_size / 50)), 6) + 0.0 AS hann, least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_retailprice / 1500)) AS clamped, greatest(p_retailprice - 1500, 0.0::DOUBLE) AS rectified FROM part""")
def scalar_functions(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        f.next_power_of_two(size).alias("power_of_two"),
        r6(f.bpm_to_lag(size, F.lit(RATE))).alias("lag"),
        r6(f.loudness(price / 1000)).alias("lufs"),
        r6(f.log_compress(price)).alias("compressed"),
        r6(f.hann(size, 50)).alias("hann"),
        f.clamp01(price / 1500).alias("clamped"),
        f.rectify(price - 1500).alias("rectified"),
    )


@query("SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) + 0.0 AS mel, round(-0.691 + 10 * log10(p_retailprice), 6) + 0.0 AS lufs FROM part")
def sql_functions(spark, sf_dir):
    f.register(spark)
    return table(spark, sf_dir, "part").select("p_partkey", r6(F.expr("hz_to_mel(p_retailprice)")).alias("mel"), r6(F.expr("loudness(p_retailprice)")).alias("lufs"))


# Channels, prefixes, frames.


@query(f"WITH {_E}, {_V}, u AS (SELECT 'E' AS kind, * FROM e UNION ALL SELECT 'V', * FROM v) SELECT kind, signal_id, round(sqrt(avg(value * value)), 6) + 0.0 AS rms, round(avg(value * value), 6) + 0.0 AS ms FROM u GROUP BY ALL")
def rms_per_signal(spark, sf_dir):
    rows = e_long(spark, sf_dir).select(F.lit("E").alias("kind"), "*").unionByName(v_long(spark, sf_dir).select(F.lit("V").alias("kind"), "*"))
    ms = F.avg(F.col("value") * F.col("value"))
    return rows.groupBy("kind", "signal_id").agg(r6(F.sqrt(ms)).alias("rms"), r6(ms).alias("ms"))


@query("SELECT vec_id AS signal_id FROM embeddings WHERE len(embedding) > 0 AND sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) >= 0.125")
def silence_filter(spark, sf_dir):
    loud = F.coalesce(f.rms(F.col("embedding")) >= 0.125, F.lit(False))
    return table(spark, sf_dir, "embeddings").where((F.size("embedding") > 0) & loud).select(F.col("vec_id").alias("signal_id"))


def _lanes(spark, sf_dir, n):
    return e_long(spark, sf_dir).select("signal_id", (F.col("idx") % n).cast("int").alias("channel"), F.floor(F.col("idx") / n).alias("idx"), "value")


@query(f"WITH {_E} SELECT signal_id, idx // 2 AS idx, round(avg(value), 4) + 0.0 AS value FROM e GROUP BY 1, 2")
def mixdown_stereo(spark, sf_dir):
    lane = lambda k: F.filter("embedding", lambda x, i: i % 2 == k)
    mixed = channels.mix_stereo(lane(0), lane(1))
    rows = windows.explode_signal(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), mixed.alias("samples")))
    return rows.select("signal_id", "idx", (F.round("value", 4) + 0.0).alias("value"))  # sums in float


@query(f"WITH {_E} SELECT signal_id, idx // 4 AS idx, round(avg(value), 6) + 0.0 AS value FROM e GROUP BY 1, 2")
def mixdown_multi(spark, sf_dir):
    return channels.mix_long(_lanes(spark, sf_dir, 4)).select("signal_id", "idx", r6(F.col("value")).alias("value"))


@query(f"WITH {_E} SELECT signal_id, idx, value FROM e WHERE idx < 20")
def partial_read(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), channels.take_seconds(F.col("embedding"), F.lit(64.0), 0.32).alias("samples"))
    return windows.explode_signal(packed)


_FRAMES = "fr AS (SELECT signal_id, k AS frame, idx - k * 4 AS i, value FROM e JOIN (SELECT unnest(range(13)) AS k) t ON idx >= k * 4 AND idx < k * 4 + 16)"


def _frames(spark, sf_dir):
    packed = windows.spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), "embedding"), "embedding")
    return windows.frames(windows.explode_signal(packed, "embedding"), 16, 4)


@query(f"WITH {_E}, {_FRAMES} SELECT signal_id, frame, i, value FROM fr")
def frames_hop(spark, sf_dir):
    return _frames(spark, sf_dir)


@query(f"WITH {_E}, {_FRAMES} SELECT signal_id, frame, i, round(value * 0.5 * (1 - cos(2 * pi() * i / 16)), 6) + 0.0 AS value FROM fr")
def hann_frames(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    return rows.withColumn("value", r6(F.col("value") * f.hann(F.col("i"), 16)))


_ENERGY = """rw AS (SELECT signal_id, idx // 8 AS w, sqrt(avg(value * value)) AS rms FROM v GROUP BY 1, 2 HAVING count(*) = 8 AND idx // 8 < 120),
pr AS (SELECT *, avg(rms) OVER (PARTITION BY signal_id ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rw),
st AS (SELECT i.signal_id, coalesce(min(w) FILTER (w > 0 AND rms > 2 * greatest(m, 0.001)) * 8, 0) AS start FROM (SELECT DISTINCT signal_id FROM v) i LEFT JOIN pr USING (signal_id) GROUP BY 1)"""


@query(f"WITH {_V}, {_ENERGY} SELECT signal_id, CAST(start AS BIGINT) AS start FROM st")
def energy_transition(spark, sf_dir):
    return windows.energy_transition(v_long(spark, sf_dir), 8)


@query(f"WITH {_V}, {_ENERGY} SELECT signal_id, CAST(idx - start AS BIGINT) AS idx, value FROM v JOIN st USING (signal_id) WHERE idx >= start AND idx < start + 16")
def analysis_window(spark, sf_dir):
    rows = v_long(spark, sf_dir)
    return windows.analysis_window(rows.join(windows.energy_transition(rows, 8), "signal_id"), F.col("start"), 16).select("signal_id", "idx", "value")


# Spectrum, mel, onset.

_SPECTRUM = """sp AS (SELECT signal_id, frame, bin, sum(x * cos(2 * pi() * i * bin / 16)) AS re, sum(x * sin(2 * pi() * i * bin / 16)) AS im
  FROM (SELECT *, value * 0.5 * (1 - cos(2 * pi() * i / 16)) AS x FROM fr) JOIN (SELECT unnest(range(9)) AS bin) b ON true GROUP BY ALL),
po AS (SELECT signal_id, frame, bin % 8 AS bin, sum(4 * (re * re + CASE WHEN bin % 8 = 0 THEN 0 ELSE im * im END)) AS power FROM sp GROUP BY 1, 2, 3)"""


def _bank_sql(rate: float, bands: int, size: int, top: float) -> str:
    mel_of = lambda hz: f"2595 * log10(1 + {hz} / 700.0)"
    return f"""ed AS (SELECT i, CAST(floor({size} * (700 * (pow(10.0, (m0 + (m1 - m0) * i / {bands + 1}) / 2595) - 1)) / {rate}) AS BIGINT) AS b
  FROM (SELECT unnest(range({bands + 2})) AS i, {mel_of(30.0)} AS m0, {mel_of(top)} AS m1)),
tr AS (SELECT x.i AS band, x.b AS l, y.b AS c, z.b AS r FROM ed x JOIN ed y ON y.i = x.i + 1 JOIN ed z ON z.i = x.i + 2),
bk AS (SELECT * FROM (SELECT band, bin, CASE WHEN r > c AND bin >= c THEN (r - bin) / (r - c) WHEN c > l AND bin <= c THEN (bin - l) / (c - l) ELSE 0 END * 2.0::DOUBLE / (r - l) AS weight
  FROM tr JOIN (SELECT unnest(range({size // 2})) AS bin) b ON bin >= l AND bin <= r WHERE r > l) WHERE weight <> 0)"""


def _small_bank(spark):
    return mel.filterbank(spark, 16000.0, 6, 16, 30.0, 8000.0)


def _energies(spark, sf_dir):
    return mel.project(spectral.power_spectrum(_frames(spark, sf_dir), 16), _small_bank(spark))


_MEL = f"""{_E}, {_FRAMES}, {_SPECTRUM}, {_bank_sql(16000.0, 6, 16, 8000.0)},
me AS (SELECT signal_id, frame, band, sum(power * weight) AS energy FROM po JOIN bk USING (bin) GROUP BY 1, 2, 3)"""
_ONSET = """ri AS (SELECT * FROM (SELECT signal_id, frame, band, greatest(l - lag(l) OVER (PARTITION BY signal_id, band ORDER BY frame), 0) AS v FROM (SELECT *, ln(1 + 100 * energy) AS l FROM me)) WHERE frame > 0)"""
_PARTS = {"low": (0, 2), "mid": (2, 4), "high": (4, 6)}


@query(f"WITH {_E}, {_FRAMES}, {_SPECTRUM} SELECT signal_id, frame, CAST(bin AS INT) AS bin, round(power, 6) + 0.0 AS power FROM po")
def power_spectrum(spark, sf_dir):
    return spectral.power_spectrum(_frames(spark, sf_dir), 16).withColumn("power", r6(F.col("power")))


def _bank_query(rate):
    return lambda spark, sf_dir: mel.filterbank(spark, rate).select("band", "bin", r6(F.col("weight")).alias("weight"))


for _rate, _name in ((44100.0, "44k"), (48000.0, "48k"), (96000.0, "96k_deadbands")):
    QUERIES[f"mel_filterbank_{_name}"] = _bank_query(_rate)
    SQL[f"mel_filterbank_{_name}"] = f"WITH {_bank_sql(_rate, 128, 2048, 16000.0)} SELECT CAST(band AS INT) AS band, CAST(bin AS INT) AS bin, round(weight, 6) + 0.0 AS weight FROM bk"


@query(f"WITH {_MEL} SELECT signal_id, frame, CAST(band AS INT) AS band, round(ln(1 + 100 * energy), 6) + 0.0 AS v FROM me")
def mel_project_log(spark, sf_dir):
    return _energies(spark, sf_dir).select("signal_id", "frame", "band", r6(f.log_compress(F.col("energy"))).alias("v"))


@query(f"WITH {_MEL}, {_ONSET} SELECT signal_id, frame, round(sum(v), 5) + 0.0 AS flux FROM ri GROUP BY 1, 2")
def onset_flux(spark, sf_dir):
    return onset.onset_long(_energies(spark, sf_dir), {}).select("signal_id", "frame", (F.round("full", 5) + 0.0).alias("flux"))


@query(f"""WITH {_MEL}, {_ONSET} SELECT signal_id, frame, round(sum(v), 5) + 0.0 AS "full",
  {", ".join(f"round(coalesce(sum(v) FILTER (band >= {a} AND band < {b}), 0), 5) + 0.0 AS {n}" for n, (a, b) in _PARTS.items())} FROM ri GROUP BY 1, 2""")
def onset_subbands(spark, sf_dir):
    rows = onset.onset_long(_energies(spark, sf_dir), _PARTS)
    return rows.select("signal_id", "frame", *[(F.round(c, 5) + 0.0).alias(c) for c in ("full", *_PARTS)])


# Periodicity and tempo.


@query(f"WITH {_E} SELECT a.signal_id, k AS lag, round(sum(a.value * b.value), 6) + 0.0 AS r FROM e a JOIN (SELECT unnest(range(32)) AS k) l ON true JOIN e b ON b.signal_id = a.signal_id AND b.idx = a.idx + k GROUP BY 1, 2")
def autocorrelation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), F.posexplode(periodicity.autocorrelation(F.col("embedding"), 32)).alias("lag", "r"))
    return rows.select("signal_id", F.col("lag").cast("long").alias("lag"), r6(F.col("r")).alias("r"))


@query(f"WITH {_H}, {_SERIES}, {_GRID}, {_TEMPO} SELECT bpm, round(v, 6) + 0.0 AS v FROM tg")
def tempogram(spark, sf_dir):
    return on_grid(chain(h_series(spark, sf_dir)), "tempogram")


@query(f"""WITH {_H}, {_SERIES}, {_ACF}, {_GRID} SELECT bpm, round(a.r + (b.r - a.r) * (lag - k), 6) + 0.0 AS v
  FROM (SELECT bpm, 6000.0::DOUBLE / bpm AS lag, CAST(floor(6000.0::DOUBLE / bpm) AS BIGINT) AS k FROM g) q JOIN acf a USING (k) JOIN acf b ON b.k = q.k + 1""")
def acf_linear(spark, sf_dir):
    at = f.let(F.col("acf"), lambda a: F.transform(periodicity.grid(), lambda b: f.interpolate_linear(a, F.col("n"), f.bpm_to_lag(b, F.lit(RATE)))))
    return on_grid(chain(h_series(spark, sf_dir)).withColumn("at", at), "at")


@query(f"WITH {_H}, {_SERIES}, {_ACF}, {_GRID}, {_parabolic('g', 'ab')} SELECT bpm, round(v, 6) + 0.0 AS v FROM ab")
def acf_parabolic(spark, sf_dir):
    at = periodicity.acf_at_tempos(F.col("acf"), F.col("n"), F.lit(RATE), periodicity.grid())
    return on_grid(chain(h_series(spark, sf_dir)).withColumn("at", at), "at")


@query(f"WITH {_chain_sql(_H)} SELECT bpm, round(v, 6) + 0.0 AS v FROM fu")
def fused_periodicity(spark, sf_dir):
    return on_grid(chain(h_series(spark, sf_dir)), "fused")


@query(f"WITH {_chain_sql(_H)} SELECT bpm, round(v, 6) + 0.0 AS v FROM en")
def tps2(spark, sf_dir):
    return on_grid(chain(h_series(spark, sf_dir)), "enhanced")


def _candidates(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode("found").alias("i", "c")).select((F.col("i") + 1).cast("long").alias("rank"), "c.bpm", r6(F.col("c.score")).alias("score"))


@query(f"WITH {_chain_sql(_H)} SELECT rank, bpm, round(score, 6) + 0.0 AS score FROM ca")
def top_candidates(spark, sf_dir):
    return _candidates(chain(h_series(spark, sf_dir)))


def _bands(spark, sf_dir) -> DataFrame:
    """One row (acfs, n): autocorrelations of the hourly counts of four bands; event types by name fall to the bands in turn."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("t"), "event_type")
    by = rows.groupBy("event_type", "t").agg(F.count("*").alias("c"))
    types = by.select("event_type").distinct().withColumn("band", (F.row_number().over(Window.orderBy("event_type")) - 1) % 4)  # a row for each type
    by = by.join(F.broadcast(types), "event_type").groupBy("band", "t").agg(F.sum("c").cast("double").alias("c"))
    span = by.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    by = by.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("m"))
    by = by.crossJoin(F.broadcast(span)).select("band", F.transform(F.sequence("a", "b"), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("x"))
    by = by.select("band", periodicity.autocorrelation(F.col("x")).alias("acf"), F.size("x").alias("n"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "acf"))), lambda b: b["acf"]).alias("acfs"), F.max("n").alias("m"))


_BANDS = f"""ty AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1) % 4 + 1 AS o FROM (SELECT DISTINCT event_type FROM events)),
bc AS (SELECT o, {_EHOUR} AS t, count(*) AS c FROM events JOIN ty USING (event_type) GROUP BY 1, 2),
bs AS (SELECT o, g.t AS i, coalesce(bc.c, 0) AS x FROM (SELECT unnest(range((SELECT min(t) FROM bc), (SELECT max(t) FROM bc) + 1)) AS t) g CROSS JOIN (SELECT DISTINCT o FROM ty) LEFT JOIN bc USING (o, t)),
ba AS (SELECT a.o, k, CAST(sum(a.x * b.x) AS DOUBLE) AS r FROM bs a JOIN (SELECT unnest(range(153)) AS k) l ON true JOIN bs b ON b.o = a.o AND b.i = a.i + k GROUP BY 1, 2),
bw(o, w) AS (VALUES (1, 0.5), (2, 1.0), (3, 1.5), (4, 2.0))"""


def _at_tempo(name: str, bpms: str) -> str:
    """Each band's autocorrelation at tempos, linear between lags."""
    return f"""{name} AS (SELECT a.o, bpm, a.r + (b.r - a.r) * (lag - q.k) AS v FROM (SELECT DISTINCT bpm, 6000.0::DOUBLE / bpm AS lag, CAST(floor(6000.0::DOUBLE / bpm) AS BIGINT) AS k FROM ({bpms}) x) q
  JOIN ba a ON a.k = q.k JOIN ba b ON b.o = a.o AND b.k = q.k + 1)"""


@query(f"""WITH {_BANDS}, q AS (SELECT unnest(range(70, 126)) AS slow), {_at_tempo("tm", "SELECT slow AS bpm FROM q UNION SELECT slow * 2 FROM q")}
SELECT slow, slow * 2 AS fast, sum(CASE WHEN f.v > l.v THEN w ELSE -w END) > 0 AS is_fast
FROM q JOIN tm l ON l.bpm = slow JOIN tm f ON f.bpm = slow * 2 AND f.o = l.o JOIN bw ON bw.o = l.o GROUP BY slow""")
def sub_band_vote(spark, sf_dir):
    pairs = spark.range(70, 126).select(F.col("id").alias("slow"), (F.col("id") * 2).alias("fast"))
    rows = _bands(spark, sf_dir).crossJoin(pairs)
    return rows.select("slow", "fast", tempo.vote_is_fast(F.col("acfs"), F.col("m"), F.col("fast"), F.col("slow"), F.lit(RATE)).alias("is_fast"))


@query(f"""WITH {_chain_sql(_H)} SELECT a.bpm AS slow, b.bpm AS fast, CAST(count(*) AS BIGINT) AS n FROM g a JOIN g b ON b.bpm / a.bpm::DOUBLE > 1.92 AND b.bpm / a.bpm::DOUBLE < 2.08
  JOIN fu x ON x.bpm = a.bpm JOIN fu y ON y.bpm = b.bpm WHERE y.v >= 0.3 * x.v GROUP BY 1, 2""")
def octave_pairs(spark, sf_dir):
    values = chain(h_series(spark, sf_dir)).select(F.posexplode("fused").alias("i", "v")).select((F.col("i") + S.BPM_MIN).cast("long").alias("bpm"), "v")
    a, b = values.select(F.col("bpm").alias("slow"), F.col("v").alias("x")), values.select(F.col("bpm").alias("fast"), F.col("v").alias("y"))
    ratio = F.col("fast") / F.col("slow")
    pairs = F.broadcast(a).join(b, (ratio > S.OCTAVE_LOW) & (ratio < S.OCTAVE_HIGH) & (F.col("y") >= S.OCTAVE_ENERGY * F.col("x")))
    return pairs.groupBy("slow", "fast").agg(F.count("*").alias("n"))


_REFINE = f"""wi AS (SELECT bpm AS w, greatest(40.0, bpm - 4) AS lo, least(250.0, bpm + 4) AS hi FROM ca WHERE rank = 1),
fg AS (SELECT w, lo + st * 0.1::DOUBLE AS bpm FROM (SELECT w, lo, unnest(range(CAST(floor((hi - lo) / 0.1 + 0.5) AS BIGINT) + 1)) AS st FROM wi)),
ft AS (SELECT bpm, sqrt(power(sum(x * cos(2 * pi() * bpm / 60 / 100 * i)), 2) + power(sum(x * sin(2 * pi() * bpm / 60 / 100 * i)), 2)) AS v FROM fg, w GROUP BY bpm),
{_parabolic("fg", "fa")},
fp AS (SELECT bpm, CASE WHEN max(ft.v) OVER () > 0 THEN ft.v / max(ft.v) OVER () ELSE 0 END * CASE WHEN max(fa.v) OVER () > 0 THEN fa.v / max(fa.v) OVER () ELSE 0 END AS p FROM ft JOIN fa USING (bpm)),
be AS (SELECT coalesce((SELECT bpm FROM fp WHERE p > 0 ORDER BY p DESC, bpm LIMIT 1), (SELECT w FROM wi)) AS bpm)"""
_CONFIDENCE = """fx AS (SELECT *, (SELECT floor(bpm + 0.5) FROM be) AS q, (SELECT bpm FROM be) AS u FROM fu),
st AS (SELECT max(v) AS top, avg(v) AS mean, coalesce(max(v) FILTER (bpm = q), 0) AS peak,
  greatest(0, max(v) FILTER (bpm <> q AND NOT (greatest(bpm, u) / least(bpm, u)::DOUBLE > 1.92 AND greatest(bpm, u) / least(bpm, u)::DOUBLE < 2.08))) AS second FROM fx),
co AS (SELECT CASE WHEN top <= 0 OR mean <= 0 THEN 0 ELSE least(1, 1 - exp(-5 * (least(1, greatest(0, (top / mean - 1) / 10)) + least(1, greatest(0, (CASE WHEN second > 0 THEN peak / second ELSE top / mean END - 1) / 5))) / 2)) END AS c FROM st)"""


def _refined(series: DataFrame) -> DataFrame:
    df = chain(series).withColumn("winner", F.get("found", F.lit(0)))
    df = df.withColumn("bpm", tempo.refine(F.col("winner.bpm"), F.col("windowed"), F.col("acf"), F.col("n"), F.lit(RATE)))
    return df.withColumn("confidence", tempo.confidence(F.col("fused"), F.col("bpm")))


@query(f"WITH {_chain_sql(_H)},\n{_REFINE} SELECT round(bpm, 6) + 0.0 AS bpm FROM be")
def refine_bpm(spark, sf_dir):
    return _refined(h_series(spark, sf_dir)).select(r6(F.col("bpm")).alias("bpm"))


@query(f"WITH {_chain_sql(_H)},\n{_REFINE},\n{_CONFIDENCE} SELECT round(c, 6) + 0.0 AS confidence FROM co")
def confidence(spark, sf_dir):
    return _refined(h_series(spark, sf_dir)).select(r6(F.col("confidence")).alias("confidence"))


@query(f"WITH {_chain_sql(_D)},\n{_REFINE},\n{_CONFIDENCE} SELECT round(bpm, 6) + 0.0 AS bpm, round(c, 6) + 0.0 AS confidence FROM be, co")
def daily_activity_tempo(spark, sf_dir):
    return _refined(d_series(spark, sf_dir)).select(r6(F.col("bpm")).alias("bpm"), r6(F.col("confidence")).alias("confidence"))


def _octave_step(k: int, i: int, j: int) -> str:
    """The best after pair (i, j), from the best before it."""
    return f"""p{k} AS (SELECT greatest(x.bpm, y.bpm) AS fast, least(x.bpm, y.bpm) AS slow, CASE WHEN x.bpm >= y.bpm THEN x.score ELSE y.score END AS score FROM ca x, ca y WHERE x.rank = {i} AND y.rank = {j}),
u{k} AS (SELECT *, fast / slow > 1.92 AND fast / slow < 2.08 AND (
    (SELECT sum(CASE WHEN f.v > l.v THEN w ELSE -w END) > 0 FROM cm f JOIN cm l USING (o) JOIN bw USING (o) WHERE f.bpm = fast AND l.bpm = slow)
    OR ((SELECT v FROM fu WHERE bpm = floor(fast)) >= 0.3 * (SELECT v FROM fu WHERE bpm = floor(slow)) AND score >= 0.5 * (SELECT score FROM b{k - 1}))) AS up FROM p{k}),
b{k} AS (SELECT CASE WHEN u.up THEN u.fast ELSE b.bpm END AS bpm, CASE WHEN u.up THEN u.score ELSE b.score END AS score FROM b{k - 1} b LEFT JOIN u{k} u ON true)"""


@query(f"""WITH {_chain_sql(_H)}, {_BANDS}, {_at_tempo("cm", "SELECT bpm FROM ca UNION SELECT unnest(range(140, 201))")},
b0 AS (SELECT bpm, score FROM ca WHERE rank = 1), {_octave_step(1, 1, 2)}, {_octave_step(2, 1, 3)}, {_octave_step(3, 2, 3)},
hh AS (SELECT bpm, v FROM cm WHERE o = 4 AND bpm BETWEEN 140 AND 200 AND bpm = floor(bpm) AND v > 0 ORDER BY v DESC, bpm LIMIT 1),
ok AS (SELECT b3.bpm BETWEEN 80 AND 130 AND hh.v > (SELECT v FROM cm WHERE o = 4 AND cm.bpm = b3.bpm)
  AND (SELECT bool_or(f.v > l.v) FROM cm f JOIN cm l USING (o) WHERE o IN (2, 3) AND f.bpm = hh.bpm AND l.bpm = b3.bpm) AS up, hh.bpm AS fast FROM b3 LEFT JOIN hh ON true)
SELECT b3.bpm AS octave_bpm, CASE WHEN ok.up THEN ok.fast ELSE b3.bpm END AS final_bpm, round(score, 6) + 0.0 AS score FROM b3, ok""")
def octave_decision(spark, sf_dir):
    """The winner after octave resolution and confirmation, with event types as bands."""
    df = chain(h_series(spark, sf_dir)).crossJoin(_bands(spark, sf_dir))
    df = df.withColumn("octave", tempo.resolve_octave(F.col("found"), F.col("fused"), F.col("acfs"), F.col("m"), F.lit(RATE)))
    df = df.withColumn("final", tempo.confirm(F.col("octave"), F.col("acfs"), F.col("m"), F.lit(RATE)))
    return df.select(F.col("octave.bpm").alias("octave_bpm"), F.col("final.bpm").alias("final_bpm"), r6(F.col("final.score")).alias("score"))


_PASSES = "pa AS (SELECT user_id AS signal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 30.0 AS DOUBLE) AS win, CASE WHEN value < 15 THEN NULL ELSE value END AS bpm, value / 250.0 AS confidence FROM events QUALIFY win <= 90)"


_PROGRESSIVE = f"""WITH {_PASSES}, a AS (SELECT *, lag(bpm) OVER (PARTITION BY signal_id ORDER BY win) AS last FROM pa WHERE bpm IS NOT NULL),
b AS (SELECT *, min(win) FILTER (confidence >= 0.4 OR abs(bpm - last) <= 2) OVER (PARTITION BY signal_id) AS stop FROM a)
SELECT signal_id, win, bpm, confidence FROM b WHERE stop IS NULL OR win <= stop QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY confidence DESC, win) = 1"""


def _window_results(spark, sf_dir) -> DataFrame:
    """Each user's first three events as the results of three windows."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), (F.row_number().over(order) * 30.0).alias("win"), F.when(F.col("value") >= 15, F.col("value")).alias("bpm"), (F.col("value") / 250).alias("confidence"))
    return rows.where("win <= 90")


@query(_PROGRESSIVE)
def progressive_select(spark, sf_dir):
    return service.progressive(_window_results(spark, sf_dir))


@query(f"SELECT signal_id, bpm, confidence FROM ({_PROGRESSIVE})")
def progressive_pick(spark, sf_dir):
    """The same through what ``analyze_bpm`` uses: a fold over an array of results."""
    none = F.array().cast("array<struct<bpm:double,score:float>>").alias("candidates")
    rows = _window_results(spark, sf_dir).groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("win", "bpm", "confidence"))).alias("r"))
    rows = rows.withColumn("best", service.pick(F.transform("r", lambda w: F.struct(w["win"].alias("win"), w["bpm"].alias("bpm"), w["confidence"].alias("confidence"), none))))
    return rows.where("best IS NOT NULL").select("signal_id", "best.bpm", "best.confidence")


# Loudness.


def _kw_sql() -> str:
    (a0, a1, a2, a3, a4), (b0, b1, b2, b3, b4) = S.K_WEIGHTING[48000]
    return f"""x AS (SELECT signal_id, idx, value FROM e),
k(signal_id, idx, x1, x2, u0, u1, u2, y1, y2) AS (
  SELECT DISTINCT signal_id, CAST(-1 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM x
  UNION ALL
  SELECT signal_id, idx, x1, x2, u0, u1, u2, {b0}::DOUBLE * u0 + {b1}::DOUBLE * u1 + {b2}::DOUBLE * u2 - ({b3}::DOUBLE) * y1 - ({b4}::DOUBLE) * y2, y1
  FROM (SELECT k.signal_id, x.idx, x.value AS x1, k.x1 AS x2, {a0}::DOUBLE * x.value + ({a1}::DOUBLE) * k.x1 + {a2}::DOUBLE * k.x2 - ({a3}::DOUBLE) * k.u0 - ({a4}::DOUBLE) * k.u1 AS u0, k.u0 AS u1, k.u1 AS u2, k.y1, k.y2
        FROM k JOIN x ON x.signal_id = k.signal_id AND x.idx = k.idx + 1))"""


@query(f"WITH RECURSIVE {_E}, {_kw_sql()} SELECT signal_id, idx, round(y1, 6) + 0.0 AS value FROM k WHERE idx >= 0")
def biquad_kweight(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), spectral.k_weighting_column(F.col("embedding"), 48000).alias("samples"))
    return windows.explode_signal(packed).withColumn("value", r6(F.col("value")))


_BLOCKS = """ch AS (SELECT signal_id, idx // 4 AS block, sum(value * value) AS s, count(*) AS c FROM {0} GROUP BY 1, 2),
bl AS (SELECT * FROM (SELECT signal_id, block, sum(s) OVER w / 16 AS ms, sum(c) OVER w AS c FROM ch WINDOW w AS (PARTITION BY signal_id ORDER BY block ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE c = 16),
lo AS (SELECT *, CASE WHEN ms > 0 THEN -0.691 + 10 * log10(ms) END AS l FROM bl)"""
_GATES = """g1 AS (SELECT * FROM lo WHERE l > -70), g2 AS (SELECT * FROM (SELECT *, -0.691 + 10 * log10(avg(ms) OVER (PARTITION BY signal_id)) - 10 AS t FROM g1) WHERE l > t)"""


def _blocks(df):
    return windows.block_mean_squares(df, 4)


@query(f"WITH {_V}, {_BLOCKS.format('v')} SELECT signal_id, block, round(ms, 8) + 0.0 AS ms FROM bl")
def block_mean_square(spark, sf_dir):
    return _blocks(v_long(spark, sf_dir)).withColumn("ms", F.round("ms", 8) + 0.0)


@query(f"WITH {_E}, {_BLOCKS.format('e')} SELECT signal_id, block, round(coalesce(l, -100), 6) + 0.0 AS lufs FROM lo")
def block_loudness(spark, sf_dir):
    return _blocks(e_long(spark, sf_dir)).select("signal_id", "block", r6(f.floor_lufs(f.loudness(F.col("ms")))).alias("lufs"))


def _gated(df, gate):
    packed = _blocks(df).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "ms"))), lambda b: b["ms"]).alias("blocks"))
    return packed.select("signal_id", gate(F.col("blocks")).alias("kept")).where(F.size("kept") > 0).select("signal_id", F.size("kept").cast("long").alias("n"), (F.round(F.aggregate("kept", F.lit(0.0), lambda s, x: s + x), 8) + 0.0).alias("total"))


@query(f"WITH {_E}, {_BLOCKS.format('e')}, {_GATES} SELECT signal_id, count(*) AS n, round(sum(ms), 8) + 0.0 AS total FROM g1 GROUP BY 1")
def absolute_gate(spark, sf_dir):
    return _gated(e_long(spark, sf_dir), loudness.absolute_gate)


@query(f"WITH {_V}, {_BLOCKS.format('v')}, {_GATES} SELECT signal_id, count(*) AS n, round(sum(ms), 8) + 0.0 AS total FROM g2 GROUP BY 1")
def relative_gate(spark, sf_dir):
    return _gated(v_long(spark, sf_dir), lambda b: loudness.relative_gate(loudness.absolute_gate(b)))


@query(f"WITH {_E}, {_BLOCKS.format('e')}, {_GATES} SELECT signal_id, round(-0.691 + 10 * log10(avg(ms)), 6) + 0.0 AS integrated_lufs FROM g2 GROUP BY 1")
def gated_loudness(spark, sf_dir):
    return loudness.integrated_long(_blocks(e_long(spark, sf_dir))).withColumn("integrated_lufs", r6(F.col("integrated_lufs")))


@query(f"WITH {_V}, {_BLOCKS.format('v')}, {_GATES} SELECT signal_id, round(-0.691 + 10 * log10(avg(ms)), 6) + 0.0 AS integrated_lufs FROM g2 GROUP BY 1")
def gated_loudness_users(spark, sf_dir):
    return loudness.integrated_long(_blocks(v_long(spark, sf_dir))).withColumn("integrated_lufs", r6(F.col("integrated_lufs")))


# Synthetic signals and whole analyses.


@query("SELECT i AS idx, round(CASE WHEN i % 22050 < 64 THEN exp(-(i % 22050) / 10.0) ELSE 0 END, 6) + 0.0 AS value FROM range(441000) t(i)")
def click_track(spark, sf_dir):
    return synth.click_track(spark, 120, 44100, 10).withColumn("value", r6(F.col("value")))


@query("SELECT i AS idx, round(sin(i * (2 * pi() * 997 / 48000)) * pow(10, -23 / 20.0) * sqrt(2) + 0.1, 6) + 0.0 AS value FROM range(48000) t(i)")
def sine_wave(spark, sf_dir):
    return synth.sine(spark, 997, 48000, 1, -23, 0.1).withColumn("value", r6(F.col("value")))


@query("SELECT i AS idx, round(sin((i % 16000) * (2 * pi() * 997 / 8000)) * pow(10, [-14, -80, -14][i // 16000 + 1] / 20.0) * sqrt(2), 6) + 0.0 AS value FROM range(48000) t(i)")
def loud_quiet_loud(spark, sf_dir):
    return synth.sine_sections(spark, 997, 8000, 2, [-14, -80, -14]).withColumn("value", r6(F.col("value")))


_M64 = "18446744073709551616::UHUGEINT"


@query(f"""WITH z0 AS (SELECT i, CAST((42::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {_M64} AS UBIGINT) AS z FROM range(10000) t(i)),
z1 AS (SELECT i, CAST((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M64} AS UBIGINT) AS z FROM z0),
z2 AS (SELECT i, CAST((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_M64} AS UBIGINT) AS z FROM z1)
SELECT i AS idx, round(CAST(xor(z, z >> 31) AS DOUBLE) / 18446744073709551615::DOUBLE * 2 - 1, 9) + 0.0 AS value FROM z2""")
def noise(spark, sf_dir):
    return synth.noise(spark, 42, 10_000).withColumn("value", F.round("value", 9) + 0.0)


@query()
def click_bpm_e2e(spark, sf_dir):
    clicks = [synth.generated(spark, f"click{b}", 44100, 15, lambda i, b=b: synth.click(i, b, 44100)) for b in (80, 85, 120, 140, 160, 170)]
    return service.estimate_bpm(reduce(DataFrame.unionByName, clicks)).drop("candidates", "error")


@query()
def progressive_bpm_e2e(spark, sf_dir):
    return service.analyze_bpm(synth.generated(spark, "click120", 44100, 100, lambda i: synth.click(i, 120, 44100))).drop("candidates", "error")


@query()
def sine_lufs_e2e(spark, sf_dir):
    sines = [synth.generated(spark, f"sine{r}", r, 10, lambda i, r=r: synth.wave(i, 997, r, -23)) for r in (44100, 48000, 96000, 22050)]
    return service.measure_loudness(reduce(DataFrame.unionByName, sines)).select("signal_id", r6(F.col("integrated_lufs")).alias("integrated_lufs"), F.size("block_lufs").alias("blocks"))


@query(f"WITH {_E} SELECT signal_id, 8000.0::DOUBLE AS sample_rate, idx, round(value, 6) + 0.0 AS value FROM e")
def wav_scan(spark, sf_dir):
    """Embeddings as WAV files, decoded again."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                x, rate = pcm.decode(wav.wav_bytes(v.values.to_numpy(zero_copy_only=False), 8000))
                yield pa.record_batch({"signal_id": pa.array([i]), "sample_rate": pa.array([rate]), "samples": pa.array([x], pa.list_(pa.float32()))})

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(encode, "signal_id long, sample_rate double, samples array<float>")
    return rows.select("signal_id", "sample_rate", F.posexplode("samples").alias("idx", "value")).select("signal_id", "sample_rate", F.col("idx").cast("long").alias("idx"), r6(F.col("value").cast("double")).alias("value"))


@query(f"""WITH {_E}, t AS (SELECT a.signal_id, o.idx, a.value, CAST(a.idx - 2 * o.idx AS DOUBLE) AS d FROM e a JOIN (SELECT unnest(range(32)) AS idx) o ON a.idx - 2 * o.idx BETWEEN -31 AND 32)
SELECT signal_id, idx, round(sum(value * 0.5 * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d / 2) / (pi() * d / 2) END * (0.5 + 0.5 * cos(pi() * d / 32))), 5) + 0.0 AS value FROM t GROUP BY 1, 2""")
def resample_signals(spark, sf_dir):
    """Each embedding at half its rate."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [resample(v.values.to_numpy(zero_copy_only=False), 64, 32) for v in batch.column("embedding")]
            yield pa.record_batch({"signal_id": batch.column("vec_id"), "samples": pa.array(out, pa.list_(pa.float32()))})

    rows = windows.explode_signal(table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "signal_id long, samples array<float>"))
    return rows.withColumn("value", F.round("value", 5) + 0.0)


def _tiled(spark, sf_dir, rate: Column, times: Column) -> DataFrame:
    """Each embedding, over and over, as a signal of some rate and length."""
    samples = F.flatten(F.array_repeat("embedding", times.cast("int")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("signal_id"), rate.cast("double").alias("sample_rate"), samples.alias("samples"))


@query("""WITH t AS (SELECT vec_id, [22050, 44100, 48000, 96000][vec_id % 4 + 1] AS rate, 64 * (270 + vec_id % 7 * 70) AS n, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64) AS rms FROM embeddings WHERE len(embedding) = 64)
SELECT CAST(vec_id AS VARCHAR) AS signal_id, rate <> 22050 AND n >= rate * 2 // 5 AS answered, CAST(CASE WHEN rate <> 22050 AND n >= rate * 2 // 5 THEN (n - rate * 2 // 5) // (rate // 10) + 1 ELSE 0 END AS BIGINT) AS blocks FROM t""")
def loudness_guards(spark, sf_dir):
    """Which signals have a loudness, by rate and length, and of how many blocks."""
    rate = F.element_at(F.array(*map(F.lit, (22050, 44100, 48000, 96000))), (F.col("vec_id") % 4 + 1).cast("int"))
    got = service.measure_loudness(_tiled(spark, sf_dir, rate, 270 + F.col("vec_id") % 7 * 70))
    return got.select("signal_id", F.col("integrated_lufs").isNotNull().alias("answered"), F.when(F.col("block_lufs").isNotNull(), F.size("block_lufs")).otherwise(0).cast("long").alias("blocks"))


@query("SELECT CAST(vec_id AS VARCHAR) AS signal_id, 64 * (50 + vec_id % 5 * 10) >= 4000 AND 64 * (50 + vec_id % 5 * 10) >= 2048 + 10 AS answered FROM embeddings WHERE len(embedding) = 64")
def tempo_guards(spark, sf_dir):
    """Which signals have a tempo, by length (at least 4 seconds)."""
    got = service.estimate_bpm(_tiled(spark, sf_dir, F.lit(1000.0), 50 + F.col("vec_id") % 5 * 10))
    return got.select("signal_id", F.col("bpm").isNotNull().alias("answered"))
