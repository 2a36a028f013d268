"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Files hold (part, offset, doc_id, n_tokens, ids) in ascending order of doc_id, within a file
and from part to part. ``offset`` counts the ids before a row in its part, so a row's place
among all ids needs only the sums of the parts. Stripes can be read in parallel; statistics
and Bloom filters on doc_id let a reader skip stripes and rows.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm.common import bounded_batches, text_chunks, trimmed

SCHEMA = "part int, offset long, doc_id long, n_tokens int, ids array<int>"
END_ID = 1
OPTIONS = {
    "compression": "lz4",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
#: Bytes of input for a file.
PART_BYTES = 256 << 20
#: Words whose ids a process remembers, and half of the most.
REMEMBERED = 400_000

#: Words of lower-case letters that normalisation leaves alone, with marks after them (but no apostrophe, which contractions begin with).
_plain = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!#$%&*,.:;?|]*)")
#: The byte-level letters: bytes that are no visible Latin-1 character stand above U+0100, in order.
_hidden = [*range(33), *range(127, 161), 173]
_byte_letters = {b: 256 + i for i, b in enumerate(_hidden)}

# The rules of the vocabulary for which texts may be parted into words. Any other vocabulary gets whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def parts_words(vocabulary: str) -> bool:
    """Whether a text's ids are its words' ids on end, as ``Encoder`` takes them."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    control = all(t["content"].startswith("<|") and t["content"].endswith("|>") and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in rules["added_tokens"])
    return plain and control and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == SPLITTER and not rules["post_processor"]


class Words(dict):
    """The ids of words; a word that is asked for the first time is among the older ones, or is learned."""

    def __init__(self, learn: Callable[[bytes], bytes], older: dict[bytes, bytes]):
        self.learn, self.older = learn, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.older.get(word) or self.learn(word)
        return ids


class Encoder:
    """The tokenizer's ids of whole texts, word by word where the vocabulary's rules allow (``parts_words``), or else text by text.

    Such a vocabulary's tokenizer drops white space and never joins what it parts, so a text's
    ids are its words' ids on end; marks after a letter at a word's end are likewise parted
    from it. It lowers case itself, so A-Z may be lowered first (not where "<|" may begin a
    control token, which is matched as written). A word of plain lower-case letters passes
    its normaliser and splitter as it is and goes straight to its model.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.by_word = parts_words(vocabulary)
        self.known = Words(self._learn, {})

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        return (raw if b"<|" in raw else raw.lower()).split()

    def _whole(self, word: str) -> bytes:
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, word: bytes) -> bytes:
        m = _plain.fullmatch(text := word.decode("utf-8", "surrogatepass"))
        if not m:
            return self._whole(text)
        if m[2]:
            return self.known[m[1].encode()] + self.known[m[2].encode()]
        letters = m[1] if m[1].isascii() else m[1].encode().decode("latin-1").translate(_byte_letters)
        return array("i", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, texts: list[str], remembered: int = REMEMBERED) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array([*e.ids, END_ID], np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > remembered:  # words that come up again pass from the older half to the new one
            self.known.older = {}
            self.known = Words(self._learn, self.known)
        get, end = self.known.__getitem__, array("i", [END_ID]).tobytes()
        return [np.frombuffer(b"".join(map(get, self.words(t))) + end, np.int32) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """This process's encoder: a Python worker keeps it, and the words it remembers, from task to task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _encoder(vocabulary: str, remembered: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, offset, part = encoder_of(vocabulary), 0, TaskContext.get().partitionId()
        for chunk in text_chunks(batches, "text", 4 << 20):
            ids = encoder.encode([t or "" for t in chunk.column("text").to_pylist()], remembered)
            n = np.array(list(map(len, ids)), np.int64)
            ends = np.cumsum(n)
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(len(ids), part, np.int32)),
                    "offset": pa.array(offset + ends - n),
                    "doc_id": chunk.column("doc_id"),
                    "n_tokens": pa.array(n.astype(np.int32)),
                    "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(ids))),
                }
            )
            offset += int(ends[-1])
        encoder.known.older = {}  # a process without a task keeps the newer half only

    return encode


def part_count(docs: DataFrame) -> int:
    """Parts of ``PART_BYTES`` in the input: by the sizes of files if ``docs`` is read from files, or else by a sum over the texts."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    if plan.children().isEmpty():
        size = int(str(plan.stats().sizeInBytes()))
    else:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / PART_BYTES))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, remembered: int = REMEMBERED) -> None:
    """Encode every whole text (null: empty), with END_ID after it, into ORC files under ``path``.

    Rows are dealt by ranges of doc_id and sorted in them (null first); rows that share an id
    follow each other in the order of their text's hash, and equal rows in that of the input,
    so that ranges can part them: a key that many rows have is no task of its own. There are
    at least as many ranges as parts of ``PART_BYTES`` in the input. An empty table writes an
    empty folder of files. Other columns are ignored. ``remembered`` bounds the words a process
    keeps from task to task; it changes speed and memory only.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    order = F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("at")
    parts = part_count(docs)
    few = parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # then the session's number, which small parts are merged from
    rows = rows.repartitionByRange(*order) if few else rows.repartitionByRange(parts, *order)
    rows = rows.sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(trimmed(_encoder(vocabulary, remembered)), SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of all ids before a row's; no rows if the files have none.

    Null and repeated ids are rows like any other. A filter on doc_id prunes stripes and rows
    by their statistics and Bloom filters.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = sums.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(sums), rows.part == sums["of"]).withColumn("start", F.col("base") + F.col("offset")).drop("of", "base")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row for each row of ``tokens``; ids count as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, bounds = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())})

    return tokens.select("doc_id", "start", "ids").mapInArrow(trimmed(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")
