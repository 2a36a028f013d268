"""What several operators of this folder share: shared storage, Arrow chunks, hashed words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.batches import bounded_batches, give_back, trimmed  # noqa: F401 - operators of this folder find them here
from sigspark.functions.scalar import let

#: Words are maximal runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``); what is there goes when this process ends.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sigspark-"))
    if not _written:
        atexit.register(_discard_all, spark)  # runs before Spark's own
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _discard_all(spark: SparkSession) -> None:
    try:
        for path in _written:
            _delete(spark, path)
    except Exception:  # noqa: BLE001, S110 - the session may be gone, and nothing depends on this
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: later jobs neither recompute it nor lose it with an executor."""
    path = shared_path(df.sparkSession, name)
    # Nobody waits for these tables, so they need no marker file, which the driver would have to write.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``table``, once all that is computed from it has been written itself."""
    _written.remove(table.kept_at)
    _delete(table.sparkSession, table.kept_at)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """In here the shuffle files of a written table go once it is written; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settle(spark: SparkSession) -> None:
    """Have the driver drop what finished queries hold there: plans, broadcast tables, states of tasks. Else its heap grows over them and stays as large."""
    gc.collect()  # Python's references keep the JVM's objects
    spark._jvm.System.gc()


def prefix_for(df: DataFrame) -> str:
    """What no column of ``df`` begins with: columns that are added under names that begin so clash with none."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: A key is hot if it has more than a share of 1 / HOT_KEYS of all rows, and more than HOT_ROWS of them: there are at most HOT_KEYS hot keys, whatever the data.
HOT_KEYS, HOT_ROWS = 10_000, 64


def hot_bound(rows: int) -> int:
    """Most rows that a key of a table of ``rows`` has without being hot."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def skew_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of ``left`` (in shared storage: it is read several times) with ``right``, which has at most a few rows a key.

    Rows of hot keys meet their key's rows of ``right`` by broadcast, a few for each of at
    most HOT_KEYS keys; only the others are shuffled, so no task gets a large part of ``left``.
    """
    hot = left.groupBy(*on).agg(F.count("*").alias("__c")).where(F.col("__c") > hot_bound(left.count())).select(*on)
    met = left.join(F.broadcast(right.join(F.broadcast(hot), on)), on)
    return met.unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))


def numbered_copies(df: DataFrame, copies: str, at: str, most: int = 10_000) -> DataFrame:
    """Each row ``copies`` times, told apart by ``at`` from 0; rows of more than ``most`` copies are dealt out in parts of so many."""
    zero = F.lit(0).cast("long")
    few = df.where(F.col(copies).between(1, most)).withColumn(at, F.explode(F.sequence(zero, F.col(copies) - 1)))
    part = F.explode(F.sequence(zero, F.col(copies) - 1, F.lit(most).cast("long")))
    many = df.where(F.col(copies) > most).withColumn("__part", part).repartition(*df.columns, "__part")
    many = many.withColumn(at, F.explode(F.sequence(F.col("__part"), F.least(F.col("__part") + most, F.col(copies)) - 1))).drop("__part")
    return few.unionByName(many)


_SUMS = 256


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each, in chunks: the cost of long arrays stays near linear."""
    zero = F.array(F.lit(0).cast("long"))
    sums = lambda a: F.aggregate(a, zero, lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    shift = lambda chunk, base: F.transform(F.slice(chunk, 1, F.size(chunk) - 1), lambda x: x + base)

    # Each value that a lambda names is bound first: written into the lambda it would be computed for each element.
    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.element_at(c, -1))
        return F.flatten(let(sums(totals), lambda bases: F.transform(chunks, lambda c, i: let(F.get(bases, i), lambda base: shift(c, base)))))

    def cut(values: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _SUMS).cast("int"))
        return F.when(F.size(values) > 0, let(F.transform(at, lambda i: sums(F.slice(values, i * _SUMS + 1, _SUMS))), over)).otherwise(F.array().cast("array<bigint>"))

    return let(lengths, cut)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text, for splits of labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each; a longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.RandomState(7).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case), and where each text's words begin among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    power, inverse = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of all its words if they are fewer."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    step = np.uint64(0xD1342543DE82EF95)
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        runs = runs * step + words[j : j + len(runs)]
    runs = mix(runs + np.uint64(k))
    out = []
    for begin, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(runs[begin : begin + n - k + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for w in words[begin : begin + n]:
                h = h * step + w
            out.append(mix(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
