"""Counts, ratios and scores against direct computation, and the bounds of the sample."""

import random

import numpy as np
from pyspark.sql import functions as F

from sigspark.llm import toxicity


def grams(text):
    """The feature numbers of a text, n-gram by n-gram."""
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text or ''} ")
    out = set()
    for n in toxicity.LENGTHS:
        for i in range(len(letters) - n + 1):
            g = letters[i : i + n]
            if " " in g[1:-1]:
                continue
            h = 0
            for c in g:
                h = (h * 0x01000193 + (0 if c == " " else ord(c))) % 2**32
            out.add((((h ^ n) * 0x9E3779B1) % 2**32) >> (32 - toxicity.BITS))
    return out


def corpus(n=120):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulmnrstÉß") for _ in range(r.randint(1, 7)))
    return [(i, " ".join([word() for _ in range(r.randint(0, 30))] + (["Blarg!x"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(n)]


def test_counts_ratios_and_scores(spark):
    rows = corpus()
    sets = [grams(t) for _, t, _ in rows]
    assert [set(g.tolist()) for g in toxicity.gram_sets([t for _, t, _ in rows])] == sets
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    ratio, n = toxicity.log_count_ratios(train)
    size = 1 << toxicity.BITS
    counts = np.ones((2, size))
    for s, (_, _, toxic) in zip(sets, rows, strict=True):
        counts[toxic, sorted(s)] += 1
    assert n == {0: 90, 1: 30}
    assert np.allclose(ratio, np.log(counts[1] / (30 + 2)) - np.log(counts[0] / (90 + 2)))
    # The same fit with a dense matrix in double precision.
    used = sorted(set().union(*sets))
    x = np.array([[g in s for g in used] for s in sets]) * ratio[used]
    y = np.array([t for _, _, t in rows], float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, sw, sb = np.zeros(len(used)), 0.0, np.full(len(used), 1e-6), 1e-6
    for _ in range(toxicity.ROUNDS):
        wrong = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        g = x.T @ wrong + toxicity.PENALTY * w
        sw, sb = sw + g * g, sb + wrong.sum() ** 2
        w, b = w - 0.05 * g / np.sqrt(sw), b - 0.05 * wrong.sum() / np.sqrt(sb)
    weights, bias = toxicity.fit(train)
    got = dict(map(tuple, toxicity.score(train, weights, bias).collect()))
    want = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose([got[i] for i in range(len(rows))], want, atol=2e-3)
    exact = [1 / (1 + np.exp(-(bias + weights[sorted(s)].sum()))) for s in sets]
    assert np.allclose([got[i] for i in range(len(rows))], exact, atol=1e-5)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    rows = [(7, f"one id, text {i}", 1) for i in range(2000)] + [(8, "same row", 0)] * 2000 + [(i, f"text {i}", i % 2) for i in range(100, 400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    assert {r.toxic: r["count"] for r in toxicity.sample_rows(train).groupBy("toxic").count().collect()} == {0: 50, 1: 50}
    again = toxicity.sample_rows(train.repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, toxicity.sample_rows(train).collect()))
    long = spark.createDataFrame([(i, "x" * 10_000 + str(i), i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    assert toxicity.sample_rows(long, 50, 200_000).groupBy("toxic").count().agg(F.max("count")).first()[0] == 4
    labels = train.select("doc_id", "toxic").distinct()
    docs = train.select("doc_id", "text")
    assert toxicity.toxicity(docs, labels).count() == len(rows)
