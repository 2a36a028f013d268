"""Gated loudness from block mean squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.functions.scalar import bound, floor_lufs, let, loudness


def _mean(a: Column) -> Column:
    return let(a, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)))


@bound("blocks")
def absolute_gate(blocks: Column) -> Column:
    """The mean squares whose loudness exceeds -70."""
    return F.filter(blocks, lambda ms: F.coalesce(loudness(ms) > S.ABSOLUTE_GATE, F.lit(False)))


@bound("gated")
def relative_gate(gated: Column) -> Column:
    """Of those, the ones that exceed the loudness of their mean less 10."""
    return let(loudness(_mean(gated)) + S.RELATIVE_GATE, lambda t: F.filter(gated, lambda ms: loudness(ms) > t))


def integrated(blocks: Column) -> Column:
    """Integrated loudness of an array of block mean squares; null if no block passes."""
    return loudness(_mean(relative_gate(absolute_gate(blocks))))


def block_series(blocks: Column) -> Column:
    """Loudness of every block before gating, with a floor."""
    return F.transform(blocks, lambda ms: floor_lufs(loudness(ms)))


def integrated_long(blocks: DataFrame) -> DataFrame:
    """(signal_id, integrated_lufs) from rows (signal_id, block, ms): both gates as filters over one partitioning."""
    by = Window.partitionBy("signal_id")
    first = blocks.withColumn("l", loudness(F.col("ms"))).where(F.col("l") > S.ABSOLUTE_GATE)
    second = first.withColumn("t", loudness(F.avg("ms").over(by)) + S.RELATIVE_GATE).where("l > t")
    return second.groupBy("signal_id").agg(loudness(F.avg("ms")).alias("integrated_lufs"))
