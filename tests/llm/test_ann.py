"""Neighbours are found whatever the norms of the vectors."""

import numpy as np
import pytest

from sigspark.llm import ann


def recall(spark, x, asked):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in ann.neighbours(df, df.where(df.vec_id < asked)).collect():
        got.setdefault(g.query_id, []).append(g.vec_id)
    hits = 0
    for q in range(asked):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20
        hits += len(set(np.argsort(-s)[:20]) & set(got[q]))
    return hits / (20 * asked)


def unit(r, n):
    x = r.randn(n, 24)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("norm", [1e4, 1e20, 1e100])
def test_one_long_vector(spark, norm):
    x = unit(np.random.RandomState(1), 1500)
    x[-1] *= norm
    assert recall(spark, x, 60) >= 0.9


def test_norms_of_many_magnitudes(spark):
    r = np.random.RandomState(2)
    x = unit(r, 1500) * 10.0 ** r.uniform(-12, 12, 1500)[:, None]
    assert recall(spark, x, 60) >= 0.9


def test_pruning_keeps_edges():
    x = unit(np.random.RandomState(3), 1)[0] + 1e-9 * unit(np.random.RandomState(4), 400)
    assert (ann.build(x).edges >= 0).sum(1).mean() > 4
    same = ann.prune(np.ones((50, 4)), np.array([0]), np.arange(50)[None], 32)
    assert (same >= 0).sum() == 32


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 250)
    monkeypatch.setattr(ann, "SLICE", 16)
    r = np.random.RandomState(6)
    x = np.vstack([unit(r, 1500), 100 * unit(r, 400)])
    assert recall(spark, x, 80) >= 0.9


def test_builders_hold_several_graphs(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 150)
    monkeypatch.setattr(ann, "BUILDERS", 2)
    assert recall(spark, unit(np.random.RandomState(7), 900), 30) >= 0.9
