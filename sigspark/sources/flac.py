"""Decoding FLAC: bit fields in Python, residuals and channels in numpy.

The unary parts of a Rice partition follow each other, so their ends are found one after the
other in a table of next set bits; all else of a partition is computed at once. Only linear
prediction with coefficients runs sample by sample.
"""

from __future__ import annotations

from operator import mul

import numpy as np

#: Fixed values of the format: block sizes and rates by their code, bits of a sample by theirs.
BLOCKS = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def accepts(data: bytes) -> bool:
    return data[:4] == b"fLaC"


class _Bits:
    """Big-endian bit fields of ``data`` from byte ``at`` on."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8
        self.base, self.ones = -1, None

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("file ends in a frame")
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def field(self, n: int, count: int) -> np.ndarray:
        """``count`` signed numbers of ``n`` bits."""
        if not n:
            return np.zeros(count, np.int64)
        a, b = self.at >> 3, (self.at + n * count + 7) >> 3
        if b > len(self.data):
            raise ValueError("file ends in a frame")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, b - a, a))[self.at - a * 8 :][: n * count].reshape(count, n)
        self.at += n * count
        value = bits.astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        return np.where(bits[:, 0] == 1, value - (1 << n), value)

    def unary(self) -> int:
        start = self.at
        while not self.take(1):
            pass
        return self.at - start - 1

    def window(self, size: int) -> None:
        """Prepare ``rice`` for the next ``size`` bytes at least."""
        self.base = self.at >> 3
        self.bits = np.unpackbits(np.frombuffer(self.data, np.uint8, min(size, len(self.data) - self.base), self.base))
        places = np.where(self.bits == 1, np.arange(len(self.bits), dtype=np.int64), len(self.bits))
        self.ones = memoryview(np.ascontiguousarray(np.minimum.accumulate(places[::-1])[::-1]))

    def rice(self, k: int, count: int) -> np.ndarray:
        """``count`` residuals of parameter ``k``."""
        if self.ones is None:
            self.window(1 << 14)
        at = self.at - self.base * 8
        ends, p, step, ones = [], at, k + 1, self.ones
        try:
            for _ in range(count):
                p = ones[p]
                ends.append(p)
                p += step
        except IndexError:
            p = len(ones) + 1
        if p > len(ones):  # the window is too short
            if self.base * 8 + len(ones) >= len(self.data) * 8 and self.base == self.at >> 3:
                raise ValueError("file ends in a frame")
            self.window(max(2 * (len(ones) >> 3), 1 << 14))
            return self.rice(k, count)
        self.at = self.base * 8 + p
        stops = np.array(ends, np.int64)
        value = stops - np.concatenate([[at], stops[:-1] + step])
        for j in range(k):
            value = value << 1 | self.bits[stops + 1 + j]
        return value >> 1 ^ -(value & 1)


def _residual(bits: _Bits, block: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or block % parts:
        raise ValueError("bad residual")
    width = 5 if method else 4
    out = []
    for part in range(parts):
        count = block // parts - (order if part == 0 else 0)
        k = bits.take(width)
        out.append(bits.field(bits.take(5), count) if k == (1 << width) - 1 else bits.rice(k, count))
    return np.concatenate(out)


def _subframe(bits: _Bits, block: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("bad subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if depth < 1:
        raise ValueError("bad sample size")
    if kind == 0:
        x = np.full(block, bits.signed(depth), np.int64)
    elif kind == 1:
        x = bits.field(depth, block)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = bits.field(depth, order)
        x = _residual(bits, block, order)
        # The residual is the difference of that order; each sum takes one order back.
        for i in range(order, 0, -1):
            x = np.cumsum(np.concatenate([np.diff(first[:i], i - 1), x]))
    elif kind >= 32:
        order = kind - 31
        history = bits.field(depth, order).tolist()
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("bad predictor")
        weights = bits.field(precision, order).tolist()[::-1]
        for r in _residual(bits, block, order).tolist():
            history.append((sum(map(mul, weights, history[-order:])) >> shift) + r)
        x = np.array(history, np.int64)
    else:
        raise ValueError("reserved subframe")
    if len(x) != block:
        raise ValueError("bad block size")
    return x << wasted


def _crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc << 1 ^ 0x07 if crc & 0x80 else crc << 1) & 0xFF
    return crc


def _frame(data: bytes, at: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """The samples (channels x block) of the frame at byte ``at``, and where it ends."""
    bits = _Bits(data, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame where one should begin")
    bits.take(1)
    size, rate, layout, width = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)  # a number in the manner of UTF-8
    for _ in range(7 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0):
        bits.take(8)
    block = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else BLOCKS.get(size)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if _crc8(data[at : bits.at >> 3]) != bits.take(8):
        raise ValueError("bad frame header")
    depth = BITS.get(width, depth)
    lanes = layout + 1 if layout < 8 else 2
    if block is None or layout > 10 or lanes != channels:
        raise ValueError("bad frame header")
    x = []
    for lane in range(lanes):
        side = (layout, lane) in ((8, 1), (9, 0), (10, 1))
        x.append(_subframe(bits, block, depth + side))
    if layout == 8:
        x[1] = x[0] - x[1]
    elif layout == 9:
        x[0] = x[0] + x[1]
    elif layout == 10:
        mid, side = x[0] << 1 | x[1] & 1, x[1]
        x = [(mid + side) >> 1, (mid - side) >> 1]
    return np.stack(x).astype(np.float64) / 2.0 ** (depth - 1), (bits.at + 7 >> 3) + 2


def decode(data: bytes, most: float | None = None) -> tuple[np.ndarray, float]:
    """(channels x frames, sample rate); of a wanted prefix only its blocks are decoded."""
    at, last, info = 4, 0, None
    while not last:
        if at + 4 > len(data):
            raise ValueError("file ends in its header")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(data[at + 14 : at + 22], "big")
        at += 4 + size
    if info is None or not info >> 44:
        raise ValueError("no stream information")
    rate, channels, depth, total = info >> 44, (info >> 41 & 7) + 1, (info >> 36 & 31) + 1, info & (1 << 36) - 1
    wanted = None if most is None else max(0, int(rate * most))
    parts, done = [np.zeros((channels, 0))], 0
    while at + 2 < len(data) and (wanted is None or done < wanted) and not (total and done >= total):
        x, at = _frame(data, at, channels, depth)
        parts.append(x)
        done += x.shape[1]
    return np.hstack(parts)[:, :wanted].astype(np.float32), float(rate)
