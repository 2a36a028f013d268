"""Change of sample rate by windowed-sinc interpolation."""

from __future__ import annotations

import numpy as np

#: Zero crossings on either side of the kernel.
CROSSINGS = 16


def resample(samples: np.ndarray, rate: float, target: float, block: int = 1 << 16) -> np.ndarray:
    """``samples`` at ``target`` samples a second: round(n * target / rate) of them."""
    n = len(samples)
    count = int(round(n * target / rate))
    cut = min(1.0, target / rate)
    half = int(np.ceil(CROSSINGS / cut))
    padded = np.concatenate([np.zeros(half), samples, np.zeros(half + 1)])
    out = np.empty(count, np.float32)
    taps = np.arange(-half + 1, half + 1)
    for a in range(0, count, block):
        place = np.arange(a, min(a + block, count)) * (rate / target)
        base = np.floor(place).astype(np.int64)
        distance = taps - (place - base)[:, None]
        kernel = cut * np.sinc(cut * distance) * (0.5 + 0.5 * np.cos(np.pi * np.clip(distance / half, -1, 1)))
        out[a : a + len(place)] = (padded[base[:, None] + taps + half] * kernel).sum(1)
    return out
