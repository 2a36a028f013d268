"""Reading WAV, AIFF and FLAC files as signals.

``read_pcm`` lists files through Spark's binary file source and so reaches every store that
Spark does. Files that are mounted on the executors are opened there and only their headers
and the wanted prefix are read; those of other stores come whole. The data source ``pcm``
does the same for mounted files. Other codecs are decoded by whatever ``register_decoder``
adds; decoders travel to the executors with the reader.
"""

from __future__ import annotations

import io
import math
import os
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sigspark.schema import ERROR
from sigspark.sources import flac
from sigspark.sources.resample import resample

SCHEMA = f"signal_id string, sample_rate double, samples array<float>, error {ERROR}"
CODES = ("fileNotReadable", "bufferAllocationFailed", "readFailed", "conversionFailed")


class PcmError(Exception):
    """``code`` is one of CODES."""

    def __init__(self, code: str, path: str, detail: str = ""):
        super().__init__(code, path, detail)
        self.code, self.path, self.detail = code, path, detail


#: (channels x frames, sample rate) from a file's bytes and the most seconds wanted.
Decoder = Callable[[bytes, float | None], tuple[np.ndarray, float]]
Decoders = list[tuple[Callable[[bytes], bool], Decoder]]
_decoders: Decoders = []

#: Bytes and files that one task of the data source reads at most, a larger file alone.
TASK_BYTES, TASK_FILES = 128 << 20, 1000


def register_decoder(accepts: Callable[[bytes], bool], decode: Decoder) -> None:
    """Add a decoder for files whose bytes ``accepts`` says yes to, tried after those above; readers made later use it."""
    _decoders.append((accepts, decode))


def _frames(total: int, rate: float, most: float | None) -> int:
    return total if most is None else max(0, min(total, math.trunc(rate * most)))


#: Widths in bytes of the kinds of samples that can be read.
WIDTHS = {"float": (4, 8), "unsigned": (1,), "signed": (1, 2, 3, 4)}


def _width(kind: str, bits: int, channels: int, rate: float) -> int:
    width = (bits + 7) // 8
    if width not in WIDTHS[kind] or channels < 1 or not rate > 0 or not math.isfinite(rate):
        raise ValueError(f"unsupported format: {channels} channels of {bits} bits ({kind}) at {rate}")
    return width


def _samples(raw: bytes, kind: str, width: int, channels: int, order: str) -> np.ndarray:
    raw = raw[: len(raw) // (channels * width) * channels * width]
    if kind == "float":
        x = np.frombuffer(raw, f"{order}f{width}").astype(np.float32)
    elif kind == "unsigned":
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if order == "<" else b[:, ::-1]
        value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = ((value ^ 0x800000) - 0x800000).astype(np.float32) / 2**23
    else:
        x = (np.frombuffer(raw, f"{order}i{width}").astype(np.float64) / 2.0 ** (8 * width - 1)).astype(np.float32)
    return x.reshape(-1, channels).T


def _chunks(f: BinaryIO, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of the body, its size) of each chunk; bodies are skipped, not read."""
    at = 12
    while True:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            return
        size = struct.unpack(f"{order}I", head[4:])[0]
        yield head[:4], at + 8, size
        at += 8 + size + size % 2


def _body(f: BinaryIO, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(max(0, size))


def _wav(f: BinaryIO, most: float | None) -> tuple[np.ndarray, float]:
    form, long = None, None
    for name, at, size in _chunks(f, "<"):
        if name == b"fmt ":
            body = _body(f, at, min(size, 40))
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            form = (struct.unpack_from("<H", body, 24)[0] if tag == 0xFFFE else tag, channels, float(rate), bits)
        elif name == b"ds64":  # sizes beyond 32 bits
            long = struct.unpack("<Q", _body(f, at + 8, 8))[0]
        elif name == b"data":
            if form is None or form[0] not in (1, 3):
                raise ValueError("unsupported WAV format")
            tag, channels, rate, bits = form
            kind = "float" if tag == 3 else "unsigned" if bits <= 8 else "signed"
            width = _width(kind, bits, channels, rate)
            size = (1 << 62 if long is None else long) if size == 0xFFFFFFFF else size
            left = max(0, f.seek(0, io.SEEK_END) - at)
            frames = _frames(min(size, left) // (channels * width), rate, most)
            return _samples(_body(f, at, frames * channels * width), kind, width, channels, "<"), rate
    raise ValueError("no data chunk")


def _aiff(f: BinaryIO, most: float | None) -> tuple[np.ndarray, float]:
    f.seek(8)
    packed, form, sound = f.read(4) == b"AIFC", None, None
    for name, at, size in _chunks(f, ">"):
        if name == b"COMM":
            body = _body(f, at, min(size, 22))
            channels, frames, bits, exponent, mantissa = struct.unpack_from(">hIhHQ", body)
            codec = body[18:22] if packed else b"NONE"
            form = (channels, frames, bits, float(mantissa) * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63), codec)
        elif name == b"SSND":
            skip = struct.unpack(">I", _body(f, at, 4))[0]
            sound = at + 8 + skip, size - 8 - skip
    if form is None or form[4] not in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64"):
        raise ValueError("unsupported AIFF format")
    channels, frames, bits, rate, codec = form
    kind = "float" if codec.lower() in (b"fl32", b"fl64") else "signed"
    width = _width(kind, bits, channels, rate)
    at, size = sound or (0, 0)
    frames = min(_frames(frames, rate, most), max(0, size) // (channels * width))
    return _samples(_body(f, at, frames * channels * width), kind, width, channels, "<" if codec == b"sowt" else ">"), rate


def decode(data: bytes | BinaryIO, path: str = "", max_seconds: float | None = None, target_rate: float | None = None, decoders: Decoders | None = None) -> tuple[np.ndarray, float]:
    """Mono float32 samples and their rate, from a file's bytes or the open file, of which no more is read than needed.

    No frames: no samples at the file's own rate, whatever ``target_rate``. Whatever is wrong
    with the bytes is ``fileNotReadable``.
    """
    f = io.BytesIO(data) if isinstance(data, bytes | bytearray | memoryview) else data
    try:
        head = f.read(12)
        if head[:4] in (b"RIFF", b"RF64") and head[8:] == b"WAVE":
            channels, rate = _wav(f, max_seconds)
        elif head[:4] == b"FORM" and head[8:] in (b"AIFF", b"AIFC"):
            channels, rate = _aiff(f, max_seconds)
        else:
            f.seek(0)
            whole = f.read()
            known = [(flac.accepts, flac.decode), *(_decoders if decoders is None else decoders)]
            decoder = next((d for accepts, d in known if accepts(whole)), None)
            if decoder is None:
                raise ValueError("no decoder for this format")
            channels, rate = decoder(whole, max_seconds)
    except (OSError, MemoryError):
        raise
    except Exception as e:  # bytes from outside can be wrong in any way
        raise PcmError("fileNotReadable", path, f"{type(e).__name__}: {e}") from e
    if not channels.shape[1]:
        return np.zeros(0, np.float32), rate
    mono = channels[0] if len(channels) == 1 else channels.sum(0, dtype=np.float32) / np.float32(len(channels))
    if target_rate is not None and target_rate != rate:
        if target_rate <= 0:
            raise PcmError("conversionFailed", path, f"rate {target_rate}")
        return resample(mono, rate, target_rate), float(target_rate)
    return mono, rate


def _row(path: str, source: Callable[[], bytes | BinaryIO], max_seconds: float | None, target_rate: float | None, mode: str, decoders: Decoders) -> tuple:
    try:
        try:
            data = source()
            try:
                samples, rate = decode(data, path, max_seconds, target_rate, decoders)
            finally:
                if hasattr(data, "close"):
                    data.close()
        except MemoryError as e:
            raise PcmError("bufferAllocationFailed", path, str(e)) from e
        except FileNotFoundError as e:
            raise PcmError("fileNotReadable", path, str(e)) from e
        except OSError as e:
            raise PcmError("readFailed", path, str(e)) from e
        return path, rate, samples, None
    except PcmError as e:
        if mode.upper() == "FAILFAST":
            raise
        return path, None, None, {"code": e.code, "path": e.path, "detail": e.detail}


def _opened(path: str) -> Callable[[], BinaryIO]:
    return lambda: open(path.removeprefix("file://").removeprefix("file:"), "rb")  # noqa: SIM115


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    error = pa.struct([("code", pa.string()), ("path", pa.string()), ("detail", pa.string())])
    ids, rates, samples, errors = zip(*rows, strict=True)
    return pa.record_batch([pa.array(ids), pa.array(rates, pa.float64()), pa.array(samples, pa.list_(pa.float32())), pa.array(errors, error)], ["signal_id", "sample_rate", "samples", "error"])


def _mounted(spark: SparkSession, paths: list[str]) -> bool:
    """Whether all of ``paths`` are of the file system that Python can open as well."""
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return all(p.startswith("file:") or (":/" not in p and default.startswith("file:")) for p in paths)


def read_pcm(spark: SparkSession, path: str | list[str], max_seconds: float | None = None, target_rate: float | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows (signal_id, sample_rate, samples, error), one a file; in mode FAILFAST a bad file raises. Spark lists no file of 0 bytes, so such have no row here."""
    decoders = list(_decoders)
    mounted = _mounted(spark, [path] if isinstance(path, str) else path)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield _batch([_row(name, _opened(name) if mounted else content.as_py, max_seconds, target_rate, mode, decoders)])

    files = spark.read.format("binaryFile").load(path)
    content = F.lit(None).cast("binary").alias("content") if mounted else F.col("content")
    return files.select("path", content).mapInArrow(load, SCHEMA)


class PcmDataSource(DataSource):
    """``spark.read.format("pcm")``: options path (one or more, comma-separated, with wildcards), maxSeconds, targetSampleRate, mode."""

    decoders: Decoders = []

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcmReader(self.options, self.decoders)


class PcmReader(DataSourceReader):
    def __init__(self, options: dict, decoders: Decoders):
        if not options.get("path"):
            raise ValueError("the data source pcm needs a path")
        self.paths, self.decoders = options["path"].split(","), decoders
        number = lambda k: float(options[k]) if options.get(k) not in (None, "") else None
        self.most, self.rate, self.mode = number("maxSeconds"), number("targetSampleRate"), options.get("mode", "PERMISSIVE")

    def partitions(self) -> list[InputPartition]:
        """Files by task: as many as their sizes allow. A name that is no file stays and gives an error row."""
        from glob import glob

        tasks, room = [], 0
        for pattern in self.paths:
            plain = pattern.removeprefix("file://").removeprefix("file:")
            names = sorted(glob(plain)) if any(c in plain for c in "*?[") else sorted(e.path for e in os.scandir(plain) if e.is_file()) if os.path.isdir(plain) else [plain]
            for name in names:
                size = os.path.getsize(name) if os.path.isfile(name) else 0
                if not tasks or size > room or len(tasks[-1]) >= TASK_FILES:
                    tasks.append([])
                    room = TASK_BYTES
                tasks[-1].append(name)
                room -= size
        return [InputPartition(t) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            yield _batch([_row(path, _opened(path), self.most, self.rate, self.mode, self.decoders)])


def register(spark: SparkSession) -> None:
    """Make the data source known; decoders registered by then go with it."""

    class Registered(PcmDataSource):  # pickled by value, with its decoders
        decoders = list(_decoders)

    spark.dataSource.register(Registered)
