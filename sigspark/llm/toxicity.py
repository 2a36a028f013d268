"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The ratios come from counts over all labelled rows; the logistic regression over the scaled
features is fitted on the driver to a bounded sample of them: ``SAMPLE`` documents a class, and
no more than ``SAMPLE_ENTRIES`` features, so that neither many rows nor long texts fill the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import bounded_batches, crc32_of_id, materialize, text_chunks

#: Lengths of the n-grams, bits of a feature's number, documents of each class that the fit sees, labels that may be broadcast.
LENGTHS, BITS, SAMPLE, BROADCAST_ROWS = (3, 4, 5, 6), 18, 1500, 2_000_000
#: Most entries of a class's feature lists in the sample, 4 bytes each, estimated from the lengths of its texts.
SAMPLE_ENTRIES = 16_000_000
#: Entries of the sample's feature lists that a step of the fit handles at once.
ENTRIES = 500_000
#: Added to each count; L2 penalty; rounds of the fit.
ALPHA, PENALTY, ROUNDS = 1.0, 2e-4, 120

_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for anything but a letter."""
    if not _fold:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def gram_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the distinct numbers of its n-grams, by their last place.

    An n-gram lies in a word or takes in one boundary at either end; all but letters are boundaries.
    """
    letters, seen = _letters(), np.zeros(1 << BITS, np.int64)
    for text in texts:
        c = np.zeros(len(text or "") + 2, np.uint32)
        c[1:-1] = letters[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        gaps = np.concatenate([[0], np.cumsum(c == 0)])
        found, h = [], np.zeros(len(c), np.uint32)
        for n in range(1, LENGTHS[-1] + 1):
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
            if n in LENGTHS and len(h):
                inner = gaps[n - 1 : len(c)] - gaps[1 : len(c) - n + 2] == 0  # no boundary but at the ends
                found.append((((h[inner] ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
        g = np.concatenate(found) if found else np.zeros(0, np.int64)
        at = np.arange(len(g))
        seen[g] = at
        yield g[seen[g] == at]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for chunk in text_chunks(batches, "text"):
        for toxic, g in zip(chunk.column("toxic").to_pylist(), gram_sets(chunk.column("text").to_pylist()), strict=True):
            counts[toxic, g] += 1
    some = np.flatnonzero(counts.sum(0))
    for i in range(0, len(some), 50_000):
        part = some[i : i + 50_000]
        yield pa.record_batch({"gram": part, "clean": counts[0, part], "toxic": counts[1, part]})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, "text"):
        sets = [g.astype(np.int32) for g in gram_sets(chunk.column("text").to_pylist())]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
        yield pa.record_batch({"doc_id": chunk.column("doc_id"), "h": chunk.column("h"), "toxic": chunk.column("toxic"), "grams": lists})


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Each feature's log ratio of its shares of toxic and of clean rows, and the number of rows by class; all 0 without rows of both."""
    n = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return np.zeros(1 << BITS), n
    sums = train.select("text", "toxic").mapInArrow(_counts, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    clean, toxic = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
    clean[sums["gram"].to_numpy()] += sums["clean"].to_numpy()
    toxic[sums["gram"].to_numpy()] += sums["toxic"].to_numpy()
    return np.log(toxic / (n[1] + 2 * ALPHA)) - np.log(clean / (n[0] + 2 * ALPHA)), n


def sample_rows(train: DataFrame, most: int | None = None, entries: int | None = None) -> DataFrame:
    """(doc_id, h, text, toxic): of each class the first ``most`` distinct rows in the order of a hash of id and text, ending where their texts may have more than ``entries`` features.

    The driver sees ids and lengths of that many rows and no text.
    """
    most, entries = SAMPLE if most is None else most, SAMPLE_ENTRIES if entries is None else entries
    h = F.xxhash64("text")
    size = F.least(F.length("text") * len(LENGTHS), F.lit(1 << BITS)).cast("long")
    keys = train.select("doc_id", "toxic", h.alias("h"), size.alias("size")).distinct()
    order = F.xxhash64(F.lit("sample"), "doc_id", "h")
    picked = []
    for c in (0, 1):
        left = entries
        for r in keys.where(F.col("toxic") == c).orderBy(order, "doc_id", "h").limit(most).collect():
            left -= r.size
            if left < 0:
                break
            picked.append((r.doc_id, r.h, c))
    picked = train.sparkSession.createDataFrame(picked, "doc_id long, h long, toxic int")
    rows = train.withColumn("h", h).join(F.broadcast(picked), ["doc_id", "h", "toxic"])
    return rows.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "text", "toxic")


def fit(train: DataFrame) -> tuple[np.ndarray, float]:
    """Weights by feature (the ratio is in them) and a bias, from rows (doc_id, text, toxic 0/1).

    Without rows of both classes all weights are 0 and the bias says how many are toxic.
    """
    ratio, n = log_count_ratios(train)
    weights = np.zeros(1 << BITS, np.float64)
    if len(n) < 2:
        return weights, float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)))
    rows = sample_rows(train).mapInArrow(_features, "doc_id long, h long, toxic int, grams array<int>").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    labels = rows["toxic"].to_numpy().astype(np.float32)
    grams = rows["grams"].combine_chunks()
    flat, starts = grams.flatten().to_numpy(), grams.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    seen = np.zeros(1 << BITS, bool)
    seen[flat] = True
    used = np.flatnonzero(seen)
    values = ratio[used].astype(np.float32)
    column = (np.cumsum(seen) - 1).astype(np.int32)[flat]
    del rows, grams, flat
    w, bias = np.zeros(len(used), np.float32), 0.0
    square, square_bias = np.full(len(used), 1e-6, np.float32), 1e-6
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())).astype(np.float32)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], ENTRIES)), len(labels)))
    for _ in range(ROUNDS):
        gradient, total, scaled = np.zeros(len(used)), 0.0, values * w
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            mine, lengths = column[starts[low] : starts[high]], np.diff(starts[low : high + 1])
            z = np.full(high - low, bias, np.float32)
            full = np.flatnonzero(lengths)
            if len(full):
                z[full] += np.add.reduceat(scaled[mine], starts[low:high][full] - starts[low])
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[low:high]) * share[low:high]
            gradient += np.bincount(mine, np.repeat(wrong, lengths), len(used))
            total += float(wrong.sum())
        gradient = gradient.astype(np.float32) * values + PENALTY * w
        square += gradient * gradient
        square_bias += total**2
        w -= 0.05 * gradient / np.sqrt(square)
        bias -= 0.05 * total / square_bias**0.5
    weights[used] = w * values
    return weights, float(bias)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every row; a null text is scored as an empty one."""
    table = weights.astype(np.float32)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            z = np.array([bias + float(table[g].sum(dtype=np.float64)) for g in gram_sets(chunk.column("text").to_pylist())])
            yield pa.record_batch({"doc_id": chunk.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from labelled ones outside the held-out fold.

    The fold is crc32 of the id as text, modulo ``folds``. Labels other than 0 and 1, null ids
    and rows without text teach nothing; several labels of an id count as their largest. All
    labelled rows count for the ratios, and rows that share an id are sampled apart, equal
    ones once. Null and empty texts get the bias's score; a null id is not held out. Rows that
    repeat each get a row. Empty documents give no rows; without labels all scores are 0.5. Columns other than
    doc_id, text and toxic are ignored.
    """
    bounded_batches(docs.sparkSession)
    fold = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds))
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold != held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    weights, bias = fit(materialize(texts.join(known, "doc_id"), "labelled"))
    scored = score(docs, weights, bias)
    held_out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
