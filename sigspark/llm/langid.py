"""Language identification of mixed text: scripts narrow the candidates, Viterbi labels the words.

Each word gets a score for each learned language, the sum of log probabilities of its letter
n-grams. Its script, found by ranges of code points, rules out languages that are not
written in it. Viterbi then finds the labels with the best sum of scores less a penalty for
each switch; runs of one label are the spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import bounded_batches, crc32_of_id, materialize, text_chunks, trimmed

#: Bits of an n-gram's number, longest n-gram, what a switch costs, least share of a language's letters in a script it counts as written in.
BITS, LONGEST, SWITCH, IN_SCRIPT = 16, 4, 8.0, 0.001
#: Bytes of text whose n-grams are held at once, and whose words are labelled at once.
PART, CHUNK = 256 << 10, 4 << 20
#: Most entries of a model, 4 bytes each: with over ENTRIES / 2**BITS languages, n-grams are numbered with fewer bits.
ENTRIES = 1 << 23
#: First and last code points of scripts; letters elsewhere are script 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
UNKNOWN = "und"

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0: no letter), and the number of its script."""
    if not _tables:
        fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                fold[c] = ord(low) if len(low) == 1 else c
        script = np.zeros(0x110000, np.uint8)
        for i, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = i
        _tables.append((fold, script))
    return _tables[0]


@dataclass
class Words:
    """Words (runs of letters) of several texts: where each begins and ends in the joined code points, its text, its n-grams."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # of each word's grams
    offsets: np.ndarray  # of each text's code points


def find_words(texts: list[str | None]) -> Words:
    fold, script = _letters()
    raw = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    c = fold[raw]
    gap = c == 0
    step = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    number = np.cumsum(step == -1)[:-1] - 1  # of the word at each letter
    places, grams = [], []
    bounded = np.concatenate([[0], c, [0]]).astype(np.uint32)  # a word's first and last n-grams see its edges
    h = np.zeros(len(bounded), np.uint32)
    for n in range(1, LONGEST + 1):
        h = h[: len(bounded) - n + 1] * np.uint32(0x01000193) + bounded[n - 1 :]
        if n > 1:
            # The n-gram at i in ``bounded`` begins one place before letter i: at an edge or at the letter before it.
            at = np.flatnonzero(~gap)
            at = at[at + n - 1 <= len(bounded) - 1]
            inside = at + n - 2 <= ends[number[at]]  # may take in the edge after the word
            at = at[inside]
            hashed = (h[at] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            places.append(number[at].astype(np.int32))
            grams.append((hashed >> np.uint32(32 - BITS)).astype(np.int32))
    word = np.concatenate(places) if places else np.zeros(0, np.int32)
    order = np.argsort(word, kind="stable")
    grams = np.concatenate(grams)[order] if grams else np.zeros(0, np.int32)
    first = np.searchsorted(word[order], np.arange(len(starts)))
    return Words(starts, ends, np.searchsorted(offsets, starts, "right") - 1, script[raw[starts]], grams, first, offsets)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n-grams (gram >= 0) and of letters by script (-1 - script) for each language."""
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for chunk in text_chunks(batches, "text", PART):
        langs = np.array(chunk.column("lang").to_pylist())
        w = find_words(chunk.column("text").to_pylist())
        word_lang = langs[w.text] if len(w.text) else np.zeros(0, str)
        for lang in np.unique(langs):
            grams, scripts = counts.setdefault(str(lang), (np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
            mine = word_lang == lang
            grams += np.bincount(w.grams[np.repeat(mine, np.diff(np.append(w.first, len(w.grams))))], minlength=1 << BITS)
            scripts += np.bincount(w.script[mine], (w.ends - w.starts)[mine], len(scripts)).astype(np.int64)
    for lang, (grams, scripts) in counts.items():
        some, used = np.flatnonzero(grams), np.flatnonzero(scripts)
        keys = np.concatenate([some, -1 - used])
        yield pa.record_batch({"lang": pa.array([lang] * len(keys)), "gram": keys, "n": np.concatenate([grams[some], scripts[used]])})


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # n-gram x language
    allowed: np.ndarray  # script x language
    shift: int = 0  # bits that an n-gram's number loses

    @property
    def chunk(self) -> int:
        """Bytes of text labelled at once: less with many languages, as each word has a score for each."""
        return max(PART, CHUNK * 16 // max(16, len(self.languages)))


def learn(train: DataFrame) -> Model:
    """From rows (lang, text): counts over all of them. Languages are sorted by code point.

    The model is in the tasks' closures and the driver sees as many counts as it has entries:
    ``ENTRIES`` bounds both, whatever the number of languages.
    """
    bounded_batches(train.sparkSession)
    counted = train.select("lang", "text").mapInArrow(trimmed(_counter), "lang string, gram long, n long")
    rows = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    languages = sorted(r.lang for r in train.select("lang").distinct().collect())
    shift = shift_for(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    gram = F.when(F.col("gram") < 0, F.col("gram")).otherwise(F.shiftright("gram", shift))
    table = rows.groupBy("lang", gram.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    counts, scripts = np.zeros((1 << (BITS - shift), len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    lang = np.array([at[x] for x in table["lang"].to_pylist()], np.int64)
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    counts[gram[gram >= 0], lang[gram >= 0]] = n[gram >= 0]
    scripts[-1 - gram[gram < 0], lang[gram < 0]] = n[gram < 0]
    smooth = counts + 0.1
    shares = scripts / np.maximum(1, scripts.sum(0))
    allowed = shares >= IN_SCRIPT
    allowed[~allowed.any(1)] = True  # a script that no language uses rules none out
    return Model(languages, np.log(smooth / smooth.sum(0)).astype(np.float32), allowed, shift)


def shift_for(languages: int) -> int:
    """Bits that the numbers of n-grams lose so that a model of so many languages has at most ``ENTRIES`` entries; two bits stay."""
    return min(BITS - 2, max(0, math.ceil(math.log2(max(1, languages) * (1 << BITS) / ENTRIES))))


def word_scores(model: Model, w: Words, block: int = 1 << 19) -> np.ndarray:
    """Word x language: sums of log probabilities less the best language's; -60 at least, as for scripts ruled out."""
    out = np.zeros((len(w.starts), len(model.languages)), np.float32)
    bounds = np.append(w.first, len(w.grams))
    at = 0
    while at < len(w.starts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, "right")) - 1)
        p = model.log_p[w.grams[bounds[at] : bounds[to]] >> model.shift]
        out[at:to] = np.add.reduceat(p, bounds[at:to] - bounds[at], axis=0)
        at = to
    out[~model.allowed[w.script]] = -1e9
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -60)


def viterbi(scores: np.ndarray, text: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word; texts are labelled apart, all at once, one word of each in a step."""
    labels = np.zeros(len(scores), np.int64)
    if not len(scores) or scores.shape[1] < 2:
        return labels
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    length = np.diff(np.append(first, len(scores)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts with so many words
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    value = scores[first].astype(np.float64)
    rows = np.arange(len(first))
    for t in range(1, int(length[0])):
        n = live[t]
        value_t = value[:n]
        best = value_t.argmax(1)
        jump = value_t[rows[:n], best][:, None] - penalty
        stay = value_t >= jump
        words = first[:n] + t
        back[words] = np.where(stay, np.arange(scores.shape[1]), best[:, None])
        value[:n] = np.where(stay, value_t, jump) + scores[words]
    state = value.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = live[t]
        words = first[:n] + t
        labels[words] = state[:n]
        if t:
            state[:n] = back[words, state[:n]]
    return labels


@dataclass
class Labelled:
    """Words of a chunk of texts, with their labels; for each text the index of its language (one past the last: none) and its share."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    found: np.ndarray
    best: np.ndarray
    share: np.ndarray


def _decide(model: Model, chunk: pa.RecordBatch) -> Labelled:
    n, langs, parts, at = chunk.num_rows, max(1, len(model.languages)), [], 0
    for part in text_chunks(iter([chunk]), "text", PART):
        w = find_words(part.column("text").to_pylist())
        scores = word_scores(model, w) if model.languages else np.zeros((len(w.starts), 1), np.float32)
        begin = w.offsets[w.text]
        parts.append(((w.starts - begin).astype(np.int32), (w.ends - begin).astype(np.int32), (w.text + at).astype(np.int32), scores))
        at += part.num_rows
    if not parts:
        parts.append((np.zeros(0, np.int32),) * 3 + (np.zeros((0, langs), np.float32),))
    starts, ends, text, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = viterbi(scores, text)
    letters = np.bincount(text * np.int64(langs) + found, ends - starts, n * langs).reshape(n, langs)
    total = letters.sum(1)
    known = (total > 0) & bool(model.languages)
    best = np.where(known, letters.argmax(1), len(model.languages))
    share = np.where(known, letters.max(1) / np.maximum(total, 1), 0.0)
    return Labelled(starts, ends, text, found, best, share)


def _labeller(model: Model):
    names = pa.array([*model.languages, UNKNOWN])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", model.chunk):
            w = _decide(model, chunk)
            found, best, share = w.found, w.best, w.share
            new = np.flatnonzero(np.concatenate([[True], (w.text[1:] != w.text[:-1]) | (found[1:] != found[:-1])])) if len(found) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(found)) - 1 if len(new) else new
            of = w.text[new]
            spans = pa.StructArray.from_arrays(
                [pa.array(w.starts[new].astype(np.int64)), pa.array(w.ends[last].astype(np.int64)), names.take(pa.array(found[new]))],
                ["start", "end", "lang"],
            )
            bounds = pa.array(np.searchsorted(of, np.arange(chunk.num_rows + 1)), pa.int32())
            yield pa.record_batch({"doc_id": chunk.column("doc_id"), "lang_pred": names.take(pa.array(best)), "score": share, "spans": pa.ListArray.from_arrays(bounds, spans)})

    return label


def accept(docs: DataFrame, train: DataFrame, least: float = 0.34) -> DataFrame:
    """The rows of ``docs`` of whose letters one language labels at least ``least``, with all their columns.

    Texts without a letter are rejected, null and empty ones among them, and so is all text
    if nothing was learned. Otherwise as ``identify``.
    """
    model = learn(train.where("lang IS NOT NULL AND text IS NOT NULL"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text", model.chunk):
            w = _decide(model, chunk)
            yield chunk.filter(pa.array((w.best < len(model.languages)) & (w.share >= least)))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row of ``docs``, learned from (lang, text) of ``train``.

    ``spans`` lists (start, end, lang) in code points, from a run's first letter to its last;
    ``lang_pred`` labels most letters and ``score`` is its share of them (ties: the first by
    code point). Texts without a letter, null and empty ones among them, are ``und`` with
    score 0 and no span; so is all text if nothing was learned. Training rows whose lang or
    text is null teach nothing. Repeated rows each get a row; empty tables give no rows;
    other columns are ignored.
    """
    model = learn(train.where("lang IS NOT NULL AND text IS NOT NULL"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(_labeller(model)), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def fold_of(folds: int = 4):
    return F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds))
