"""Connected components of an edge table, in a number of rounds that grows with the logarithm of their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sigspark.llm.common import discard, hot_bound, materialize, trimmed

#: Distinct edges that one task solves in memory (some 200 MB at most); more are solved in rounds over all tasks.
IN_ONE_TASK = 2_000_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long), root being the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stay
    as they are. Each step is an aggregation by node with partial sums on the map side, whose
    result the edges then look up (hot nodes by broadcast); each round's edges are written to
    shared storage. Nulls and loops are ignored; repeated edges count once; an empty table
    gives an empty result. Up to ``IN_ONE_TASK`` distinct edges take no rounds: one task
    solves them, as the plans of many small rounds cost the driver more than the edges do.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, sign = _round(edges)
    if sign[0] <= IN_ONE_TASK:
        return edges.coalesce(1).mapInArrow(trimmed(_solve), "node long, root long")
    for _ in range(rounds):
        if not sign[0]:
            break
        # Every edge's larger end is tied to the least node about its smaller end.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"), "c")
        large = _looked_up(edges, "b", least, sign[0]).select("a", F.col("m").alias("b"))
        # All smaller nodes about a node, and the node, are tied to the least of them.
        least = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = _looked_up(large, "a", least, sign[0]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, old = sign, edges
        edges, sign = _round(small.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).where("a != b"))
        discard(old)
        if sign == before:
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct()).withColumnRenamed("a", "node")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for all nodes of the edges in ``batches``."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate([a for a, _ in held] + [b for _, b in held])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    for i in range(0, len(nodes), 1 << 16):
        yield pa.record_batch({"node": nodes[i : i + (1 << 16)], "root": nodes[root[i : i + (1 << 16)]]})


def _looked_up(edges: DataFrame, end: str, table: DataFrame, rows: int) -> DataFrame:
    """``edges`` with the ``m`` of ``table`` (of, m, c) for the node at ``end``; ``c`` counts a node's edges.

    Hot nodes' values are broadcast, at most HOT_KEYS of them; their edges go to the other
    join under hashes of their own, spread over all tasks.
    """
    hot = table.where(F.col("c") > hot_bound(rows)).select(F.col("of").alias("hot"), F.col("m").alias("hot_m"))
    edges = edges.join(F.broadcast(hot), F.col(end) == F.col("hot"), "left")
    edges = edges.withColumn("k", F.when(F.col("hot").isNull(), F.col(end)).otherwise(F.xxhash64("a", "b")))
    found = edges.join(table.select("of", F.col("m").alias("cold_m")), F.col("k") == F.col("of"), "left")
    return found.select("a", "b", F.coalesce("hot_m", "cold_m").alias("m"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges in shared storage, with their number and a sum of their hashes, taken while they are written."""
    seen = Observation()
    edges = edges.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    edges = materialize(edges, "edges")
    return edges, (seen.get["n"], seen.get["sum"])
