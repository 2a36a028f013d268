"""Writing signals as WAV files (32-bit float), for fixtures and exchange."""

from __future__ import annotations

import struct

import numpy as np


def wav_bytes(channels: np.ndarray, sample_rate: int, extra: bytes = b"") -> bytes:
    """A file's bytes from channels x frames; ``extra`` holds chunks that go before the samples."""
    x = np.atleast_2d(np.asarray(channels, "<f4"))
    n = len(x)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, n, sample_rate, sample_rate * 4 * n, 4 * n, 32)
    data = x.T.tobytes()
    body = form + extra + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body
