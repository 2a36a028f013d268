"""Column layouts and the constants of all operators."""

from __future__ import annotations

SIGNAL_PACKED = "signal_id string, sample_rate double, samples array<float>"
SIGNAL_LONG = "signal_id string, sample_rate double, idx long, value double"
ERROR = "struct<code:string,path:string,detail:string>"
TEMPO_RESULT = f"signal_id string, bpm double, confidence double, candidates array<struct<bpm:double,score:float>>, error {ERROR}"
LOUDNESS_RESULT = f"signal_id string, integrated_lufs double, block_lufs array<double>, block_step_seconds double, error {ERROR}"

# Fixed values of the analysis.
FFT_SIZE, BINS, MEL_BANDS, FMIN, FMAX, LOG_SCALE = 2048, 1024, 128, 30.0, 16000.0, 100.0
BPM_MIN, BPM_MAX = 40, 250
SILENCE_RMS, MIN_SECONDS = 0.001, 4.0
ENERGY_FACTOR, ENERGY_WINDOWS = 2.0, 120
TEMPOGRAM_SECONDS = 8.0
PERCEPTUAL_MIN, PERCEPTUAL_MAX = 60.0, 200.0
OCTAVE_ENERGY, OCTAVE_SCORE, OCTAVE_LOW, OCTAVE_HIGH = 0.3, 0.5, 1.92, 2.08
BANDS = {"kick": (0, 20), "snareLow": (20, 50), "snareCrack": (50, 80), "hiHat": (80, 128)}
BAND_WEIGHTS = (0.5, 1.0, 1.5, 2.0)
TOP = 3
PROMOTE_MIN, PROMOTE_MAX, FAST_MIN, FAST_MAX = 80.0, 130.0, 140, 200
REFINE_SPAN, REFINE_STEP = 4.0, 0.1
WINDOWS, ENOUGH, CONVERGED = (30.0, 60.0, 90.0), 0.40, 2.0
TEMPO_SECONDS, LUFS_SECONDS = 120.0, 30.0
LUFS_OFFSET, ABSOLUTE_GATE, RELATIVE_GATE, LUFS_FLOOR, BLOCK_STEP = -0.691, -70.0, -10.0, -100.0, 0.1

# K-weighting by sample rate, (b0, b1, b2, a1, a2) of the shelf and of the high pass. The row of 96000 is not
# equivalent to the others: it reads 0.477 LU low at 997 Hz.
K_WEIGHTING = {
    44100: (
        (1.530841230050348, -2.650979995154729, 1.169079079921587, -1.663655113256020, 0.712595428073225),
        (0.999560064542514, -1.999120129085029, 0.999560064542514, -1.989169673629796, 0.989199035787039),
    ),
    48000: (
        (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585),
        (1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621),
    ),
    96000: (
        (1.537185173610400, -2.718780265928710, 1.218990510102450, -1.710656503758280, 0.747317008498040),
        (0.999780299723625, -1.999560599447250, 0.999780299723625, -1.994582958828822, 0.994588012554209),
    ),
}

#: Accepted names of the disambiguation strategy; both give the same result.
STRATEGIES = ("subBandVoting", "beatPhase")
