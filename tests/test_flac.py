"""FLAC files of every kind of block, written here bit by bit, decode to their samples."""

import numpy as np
import pytest

from sigspark.sources import flac, pcm


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [int(value) >> i & 1 for i in range(n - 1, -1, -1)]

    def rice(self, values, k):
        for v in values:
            u = int(v) << 1 if v >= 0 else (-int(v) << 1) - 1
            self.bits += [0] * (u >> k) + [1]
            self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def residual(w, values, order, parts, k, escape=False):
    w.put(0, 2)
    w.put(parts.bit_length() - 1, 4)
    size, at = (len(values) + order) // parts, 0
    for part in range(parts):
        n = size - order if part == 0 else size
        chunk = values[at : at + n]
        at += n
        if escape:
            w.put(15, 4)
            w.put(17, 5)
            for v in chunk:
                w.put(v, 17)
        else:
            w.put(k, 4)
            w.rice(chunk, k)


def subframe(w, x, depth, kind):
    w.put(0, 1)
    wasted = 2 if kind == "wasted" else 0
    if kind == "constant":
        w.put(0, 7)
        w.put(x[0], depth)
    elif kind in ("verbatim", "wasted"):
        w.put(1, 6)
        w.put(bool(wasted), 1)
        w.bits += [0] * (wasted - 1) + [1] if wasted else []
        for v in x:
            w.put(v >> wasted, depth - wasted)
    elif kind.startswith("fixed"):
        order = int(kind[5])
        w.put(8 + order, 6)
        w.put(0, 1)
        for v in x[:order]:
            w.put(v, depth)
        residual(w, np.diff(x, order), order, 4, 5, escape=order == 3)
    else:
        weights, shift = [30, -13, 2], 4
        w.put(32 + len(weights) - 1, 6)
        w.put(0, 1)
        for v in x[:3]:
            w.put(v, depth)
        w.put(7 - 1, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, 7)
        guess = [(30 * int(x[i - 1]) - 13 * int(x[i - 2]) + 2 * int(x[i - 3])) >> shift for i in range(3, len(x))]
        residual(w, x[3:] - np.array(guess), 3, 1, 8)


def crc16_free(body):
    return body + b"\0\0"


def frame(x, number, layout, depth, kinds):
    n = x.shape[1]
    w = Writer()
    w.put(0x7FFC, 15)
    w.put(0, 1)
    w.put(7, 4)
    w.put(0, 4)
    w.put(layout, 4)
    w.put(0, 4)
    if number < 128:
        w.put(number, 8)
    else:
        w.put(0xC0 | number >> 6, 8)
        w.put(0x80 | number & 63, 8)
    w.put(n - 1, 16)
    w.put(flac._crc8(w.bytes()), 8)
    lanes = {8: lambda a: [a[0], a[0] - a[1]], 9: lambda a: [a[0] - a[1], a[1]], 10: lambda a: [a[0] + a[1] >> 1, a[0] - a[1]]}.get(layout, list)(x)
    for i, (lane, kind) in enumerate(zip(lanes, kinds, strict=True)):
        subframe(w, lane, depth + ((layout, i) in ((8, 1), (9, 0), (10, 1))), kind)
    return crc16_free(w.bytes())


def stream(frames, rate, channels, depth, total):
    info = bytes(10) + (rate << 44 | channels - 1 << 41 | depth - 1 << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x84\x00\x00\x04abcd" + b"".join(frames)


def smooth(n, channels, seed):
    r = np.random.RandomState(seed)
    return np.cumsum(np.cumsum(r.randint(-3, 4, (channels, n)), 1), 1) // 4


KINDS = ["verbatim", "wasted", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "lpc"]


@pytest.mark.parametrize("layout", [0, 1, 8, 9, 10])
def test_round_trip(layout):
    channels = 1 if layout == 0 else 2
    blocks, frames = [], []
    for i, kind in enumerate(KINDS):
        x = smooth(64, channels, i).astype(np.int64)
        x = x << 2 if kind == "wasted" and layout == 0 else x
        kind = "verbatim" if kind == "wasted" and layout else kind
        blocks.append(x)
        frames.append(frame(x, 120 + i * 3, layout, 16, [kind] * channels))
    blocks.append(np.full((channels, 64), -7))
    frames.append(frame(blocks[-1], 200, 0 if channels == 1 else 1, 16, ["constant"] * channels))
    want = np.hstack(blocks)
    data = stream(frames, 44100, channels, 16, want.shape[1])
    got, rate = flac.decode(data)
    assert rate == 44100 and np.array_equal(got * 32768, want)
    assert flac.decode(data, 100 / 44100)[0].shape[1] == 100
    mono, rate = pcm.decode(data)
    assert np.allclose(mono, want.mean(0) / 32768) and rate == 44100


def test_long_codes_and_bad_files():
    x = np.random.RandomState(1).randint(-(2**15), 2**15, (1, 4096)).astype(np.int64)
    data = stream([frame(x, 0, 0, 16, ["fixed0"])], 8000, 1, 16, 4096)  # codes of thousands of zeros: many windows
    assert np.array_equal(flac.decode(data)[0] * 32768, x)
    for cut in (20, 41, 60, 500, len(data) - 40):
        with pytest.raises(pcm.PcmError, match="fileNotReadable"):
            pcm.decode(data[:cut])
    broken = bytearray(data)
    broken[52] ^= 0x55
    with pytest.raises(pcm.PcmError, match="fileNotReadable"):
        pcm.decode(bytes(broken))
