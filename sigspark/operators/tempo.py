"""From periodicity to a tempo: candidates, octave decisions, refinement, confidence. All on arrays in a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions.scalar import bound, bpm_to_lag, clamp01, interpolate_linear, let, range_normalize
from sigspark.operators.periodicity import acf_at_tempos, fourier_magnitudes


@bound("enhanced")
def top_candidates(enhanced: Column, count: int = S.TOP) -> Column:
    """Array of (bpm, score): the best strict local maxima, normalised in range.

    Order: score, then interior peaks by tempo, then the first end, then the last.
    """
    last = F.size(enhanced) - 1
    left, right = (lambda i: F.get(enhanced, i - 1)), (lambda i: F.get(enhanced, i + 1))
    peaks = F.transform(
        enhanced,
        lambda v, i: F.when(
            F.when(i == 0, v > right(i)).when(i == last, v > left(i)).otherwise((v > left(i)) & (v > right(i))),
            F.struct(
                (-v).alias("key"),
                F.when(i == 0, 1).when(i == last, 2).otherwise(0).alias("kind"),
                i.alias("i"),
                range_normalize((i + S.BPM_MIN).cast("double")).alias("bpm"),
                v.alias("score"),
            ),
        ),
    )
    best = F.slice(F.array_sort(F.filter(peaks, lambda p: p.isNotNull())), 1, count)
    return F.transform(best, lambda p: F.struct(p["bpm"].alias("bpm"), p["score"].alias("score")))


def band_votes(acfs: Column, n: Column, fast: Column, slow: Column, onset_rate: Column) -> Column:
    """For each band: is its autocorrelation stronger at the faster tempo?"""
    return F.transform(acfs, lambda a: interpolate_linear(a, n, bpm_to_lag(fast, onset_rate)) > interpolate_linear(a, n, bpm_to_lag(slow, onset_rate)))


@bound("acfs")
def vote_is_fast(acfs: Column, n: Column, fast: Column, slow: Column, onset_rate: Column) -> Column:
    """Whether the weighted vote of four bands is for the faster tempo; a tie is for the slower. Another number of bands doesn't vote: the faster stands."""
    weights = F.array(*map(F.lit, S.BAND_WEIGHTS))
    sides = F.zip_with(band_votes(acfs, n, fast, slow, onset_rate), weights, lambda v, w: F.when(v, w).otherwise(-w))
    return F.when(F.size(acfs) == 4, F.aggregate(sides, F.lit(0.0), lambda s, x: s + x) > 0).otherwise(F.lit(True))


def _is_octave(a: Column, b: Column) -> Column:
    ratio = F.greatest(a, b) / F.least(a, b)
    return (ratio > S.OCTAVE_LOW) & (ratio < S.OCTAVE_HIGH)


@bound("candidates", "fused", "acfs")
def resolve_octave(candidates: Column, fused: Column, acfs: Column, n: Column, onset_rate: Column) -> Column:
    """(bpm, score) after the pairs (0,1), (0,2), (1,2) in this order; a pair can only raise the tempo.

    It does where four bands vote for the faster tempo, or else where that has energy and
    score enough; without four bands only energy and score count.
    """
    at = lambda c: F.when((c["bpm"] >= S.BPM_MIN) & (c["bpm"] < S.BPM_MAX + 1), F.get(fused, (F.floor(c["bpm"]) - S.BPM_MIN).cast("int")))

    def step(i: int, j: int):
        a, b = F.get(candidates, F.lit(i)), F.get(candidates, F.lit(j))
        fast, slow = F.when(a["bpm"] >= b["bpm"], a).otherwise(b), F.when(a["bpm"] >= b["bpm"], b).otherwise(a)

        def raised(best: Column) -> Column:
            strong = (at(fast) >= S.OCTAVE_ENERGY * at(slow)) & (fast["score"] >= S.OCTAVE_SCORE * best["score"])
            voted = F.when(F.size(acfs) == 4, vote_is_fast(acfs, n, fast["bpm"], slow["bpm"], onset_rate))
            up = _is_octave(a["bpm"], b["bpm"]) & (F.coalesce(voted, F.lit(False)) | F.coalesce(strong, F.lit(False)))
            return F.when(b.isNotNull() & F.coalesce(up, F.lit(False)), fast).otherwise(best)

        return raised

    best = F.get(candidates, F.lit(0))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        best = let(best, step(i, j))
    return best


@bound("winner", "acfs")
def confirm(winner: Column, acfs: Column, n: Column, onset_rate: Column) -> Column:
    """Promotes a middle tempo to the fast one that the hi-hat band and a snare band prefer; the score stays."""
    strength = lambda a, bpm: interpolate_linear(a, n, bpm_to_lag(bpm, onset_rate))
    hat = F.get(acfs, F.lit(3))
    each = F.transform(F.sequence(F.lit(S.FAST_MIN), F.lit(S.FAST_MAX)), lambda b: F.struct(strength(hat, b).alias("s"), (-b).alias("b")))

    def decide(best: Column) -> Column:
        fast = (-best["b"]).cast("double")
        snare = F.exists(F.slice(acfs, 2, 2), lambda a: strength(a, fast) > strength(a, winner["bpm"]))
        promoted = (F.size(acfs) == 4) & winner["bpm"].between(S.PROMOTE_MIN, S.PROMOTE_MAX) & best.isNotNull() & (best["s"] > strength(hat, winner["bpm"])) & snare
        return F.when(F.coalesce(promoted, F.lit(False)), F.struct(fast.alias("bpm"), winner["score"].alias("score"))).otherwise(winner)

    return let(F.array_max(F.filter(each, lambda e: e["s"] > 0)), decide)


@bound("bpm", "windowed", "acf")
def refine(bpm: Column, windowed: Column, acf: Column, n: Column, onset_rate: Column) -> Column:
    """The tempo within 4 of ``bpm``, in steps of 0.1, where tempogram times autocorrelation is largest."""
    low, high = F.greatest(F.lit(float(S.BPM_MIN)), bpm - S.REFINE_SPAN), F.least(F.lit(float(S.BPM_MAX)), bpm + S.REFINE_SPAN)
    bpms = F.transform(F.sequence(F.lit(0), F.floor((high - low) / S.REFINE_STEP + 0.5).cast("int")), lambda i: low + i * S.REFINE_STEP)
    over = lambda a: let(a, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.when(top > 0, x / top).otherwise(0.0))))

    def search(tempos: Column) -> Column:
        product = F.zip_with(over(fourier_magnitudes(windowed, onset_rate, tempos)), over(acf_at_tempos(acf, n, onset_rate, tempos)), lambda a, b: a * b)
        best = F.array_max(F.filter(F.zip_with(product, tempos, lambda p, b: F.struct(p.alias("p"), (-b).alias("b"))), lambda e: e["p"] > 0))
        return F.coalesce(-best["b"], bpm)

    return let(bpms, search)


@bound("fused", "bpm")
def confidence(fused: Column, bpm: Column) -> Column:
    """From 0 to 1: how far the peak stands over the mean and over all but its octaves (those of ``bpm`` itself, which needn't be whole)."""
    at = (F.floor(bpm + 0.5) - S.BPM_MIN).cast("int")
    others = F.filter(F.transform(fused, lambda v, i: F.when((i != at) & ~_is_octave((i + S.BPM_MIN).cast("double"), bpm), v)), lambda v: v.isNotNull())
    facts = F.struct(
        F.array_max(fused).alias("top"),
        (F.aggregate(fused, F.lit(0.0), lambda s, x: s + x) / F.size(fused)).alias("mean"),
        F.when((at >= 0) & (at < F.size(fused)), F.get(fused, at)).otherwise(0.0).alias("peak"),
        F.greatest(F.lit(0.0), F.array_max(others)).alias("second"),
    )

    def score(f: Column) -> Column:
        par = f["top"] / f["mean"]
        clarity = F.when(f["second"] > 0, f["peak"] / f["second"]).otherwise(par)
        combined = (clamp01((par - 1) / 10) + clamp01((clarity - 1) / 5)) / 2
        return F.when((f["top"] <= 0) | (f["mean"] <= 0) | f["top"].isNull(), F.lit(0.0)).otherwise(F.least(1 - F.exp(-5 * combined), F.lit(1.0)))

    return let(facts, score)
