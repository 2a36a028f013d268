"""Approximate nearest neighbours: one robust-pruned directed graph for each shard of vectors.

Nearness is the inner product. With one more coordinate that gives all vectors of a shard the
same length, the nearest by inner product are the nearest by distance, so the graph's
distance pruning applies. Vectors are added in batches of growing size: a beam search over
the graph so far proposes neighbours, and pruning keeps a neighbour only if no kept one is
nearer to it by the factor ``ALPHA``; edges back are added and pruned likewise. Beside a far
longer vector all others would be lifted to one point, so a shard holds norms of one order
of magnitude; a query searches all shards. Shards have a bounded size, so their number grows with the data and a graph fits in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import bounded_batches, materialize, trimmed

#: Vectors in a shard, nodes or queries handled at once in a task, edges of a node, beam while building and while searching, pruning factor.
SHARD, SLICE, DEGREE, BUILD, BEAM, ALPHA = 16_384, 512, 32, 64, 96, 1.2
#: Most tasks that build graphs; beyond it a task builds several, one after the other.
BUILDERS = 20_000
#: Shards up to which the table of their numbers, a row for each length and range of norms, is broadcast.
BROADCAST_ROWS = 100_000
#: Binary orders of magnitude that the norms of a shard's vectors span at most: single precision tells lifted vectors apart.
NORMS = 4
_STEP = 4  # nodes of a beam that are expanded at once


@dataclass
class Graph:
    """``vectors`` are of one length; row i's neighbours are ``edges[i]``, -1 where it has fewer."""

    vectors: np.ndarray
    edges: np.ndarray
    start: int


class Marks:
    """Room for what a search marks, by query and node; used again by the next search of the same graph."""

    def __init__(self, queries: int, nodes: int):
        self.seen = np.zeros((queries, nodes + 1), bool)  # the last place stands for no neighbour
        self.stamp = np.zeros((queries, nodes + 1), np.int16)

    def of(self, queries: int) -> tuple[np.ndarray, np.ndarray]:
        seen = self.seen[:queries]
        seen[:] = False
        seen[:, -1] = True
        return seen, self.stamp[:queries]


def search(graph: Graph, queries: np.ndarray, beam: int, marks: Marks | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes found (-1: none) and their inner products, nearest first."""
    count = len(queries)
    ids = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    seen, stamp = (marks or Marks(count, len(graph.vectors))).of(count)
    ids[:, 0], near[:, 0], done[:, 0] = graph.start, queries @ graph.vectors[graph.start], False
    seen[:, graph.start] = True
    while True:
        order = np.argsort(done, axis=1, kind="stable")[:, :_STEP]  # the first that aren't expanded
        fresh = ~np.take_along_axis(done, order, 1)
        active = np.flatnonzero(fresh.any(1))
        if not len(active):
            return ids, near
        order, fresh = order[active], fresh[active]
        at = np.take_along_axis(ids[active], order, 1)
        out = graph.edges[at]
        out[~fresh] = -1
        out = out.reshape(len(active), -1)
        sub = active[:, None]
        np.put_along_axis(flags := done[active], order, True, 1)
        done[active] = flags
        place = np.broadcast_to(np.arange(out.shape[1], dtype=np.int16), out.shape)
        stamp[sub, out] = place
        new = (stamp[sub, out] == place) & ~seen[sub, out]
        seen[sub, out] = True
        width = max(1, int(new.sum(1).max()))
        pick = np.argsort(~new, axis=1, kind="stable")[:, :width]
        out, new = np.take_along_axis(out, pick, 1), np.take_along_axis(new, pick, 1)
        score = np.einsum("qwd,qd->qw", graph.vectors[out], queries[active])
        score[~new] = -np.inf
        all_near = np.concatenate([near[active], score], 1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[active] = np.take_along_axis(all_near, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, out, -1)], 1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~new], 1), best, 1)


def lifted(points: np.ndarray) -> np.ndarray:
    """Points over their largest norm, with one more coordinate that gives all the length 1; double precision."""
    points = points / np.abs(points).max()
    squares = np.einsum("nd,nd->n", points, points)
    top = squares.max()
    return np.hstack([points, np.sqrt(np.maximum(0, top - squares))[:, None]]) / np.sqrt(top)


def prune(vectors: np.ndarray, of: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """For each node of ``of`` up to ``degree`` diverse neighbours out of its row of ``pool`` (-1: none).

    ``vectors`` are in double precision, and distances are taken from differences to the node.
    """
    cloud = vectors[pool] - vectors[of][:, None]
    far = np.einsum("bcd,bcd->bc", cloud, cloud)  # the squared distance
    far[(pool < 0) | (pool == of[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    pool, far = np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)
    cloud = np.take_along_axis(cloud, order[:, :, None], 1)
    alive = np.isfinite(far)
    far[~alive] = 0
    spare = alive & (far == 0)
    out = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    for k in range(degree):
        # Neighbours at no measurable distance prune each other; they fill places that are left.
        alive = np.where(alive.any(1)[:, None], alive, spare)
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = pool[rows, first][some]
        between = np.maximum(0, far + far[rows, first][:, None] - 2 * np.einsum("bcd,bd->bc", cloud, cloud[rows, first]))
        alive &= ALPHA * ALPHA * between > far
        alive[rows, first] = spare[rows, first] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD) -> Graph:
    """The graph of distinct finite vectors."""
    exact = lifted(points)
    vectors = exact.astype(np.float32)
    n = len(vectors)
    middle = int(np.argmax(vectors @ vectors.mean(0)))
    graph = Graph(vectors, np.full((n, degree), -1, np.int32), middle)
    order = np.random.RandomState(3).permutation(n)
    order = np.concatenate([[middle], order[order != middle]])
    done, marks = 1, Marks(min(n, SLICE), n)
    while done < n:
        batch = order[done : done + min(done, SLICE)]
        found, _ = search(graph, vectors[batch], min(beam, done), marks)
        # Those of one batch don't see each other in the graph; a few of them are proposed as well.
        peers = batch[np.argsort(-(vectors[batch] @ vectors[batch].T), axis=1, kind="stable")[:, : degree // 2 + 1]]
        graph.edges[batch] = prune(exact, batch, np.hstack([found, peers.astype(np.int32)]), degree)
        source = np.repeat(batch, degree)
        target = graph.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        nearness = np.einsum("ed,ed->e", vectors[source], vectors[target])
        by = np.lexsort((-nearness, target))
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        keep = rank < 2 * degree
        back = np.full((len(nodes), min(2 * degree, int(counts.max()))), -1, np.int32)
        back[np.repeat(np.arange(len(nodes)), counts)[keep], rank[keep]] = source[keep]
        for a in range(0, len(nodes), SLICE):
            some = nodes[a : a + SLICE]
            pool = np.hstack([graph.edges[some], back[a : a + SLICE]])
            pool.sort(1)
            pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
            graph.edges[some] = prune(exact, some, pool, degree)
        done += len(batch)
    return graph


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    lists = table["vector"].combine_chunks() if isinstance(table["vector"], pa.ChunkedArray) else table["vector"]
    points = lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    order = np.lexsort(points.T[::-1])
    points = np.ascontiguousarray(points[order])
    graph = build(points)
    return pa.table(
        {
            "dim": table["dim"][:1],
            "shard": table["shard"][:1],
            "points": pa.array([points.tobytes()], pa.binary()),
            "edges": pa.array([graph.edges.tobytes()], pa.binary()),
            "start": pa.array([graph.start], pa.int32()),
            "members": pa.array([table["members"].take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
        }
    )


class _Held:
    """A graph as a task holds it while queries pass."""

    def __init__(self, row: pa.RecordBatch):
        dim = row.column("dim")[0].as_py()
        self.points = np.frombuffer(row.column("points")[0].as_py(), np.float64).reshape(-1, dim)
        edges = np.frombuffer(row.column("edges")[0].as_py(), np.int32).reshape(len(self.points), -1)
        self.graph = Graph(lifted(self.points).astype(np.float32), edges, row.column("start")[0].as_py())
        self.members = row.column("members")[0].as_py()
        self.marks = Marks(SLICE, len(self.points))

    def nearest(self, queries: pa.RecordBatch, k: int, beam: int) -> pa.RecordBatch:
        asked, out = queries.column("query_id").to_pylist(), []
        vectors = queries.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
        padded = np.hstack([vectors / np.abs(vectors).max(1)[:, None], np.zeros((len(vectors), 1))]).astype(np.float32)
        for a in range(0, len(asked), SLICE):
            some = padded[a : a + SLICE]
            every = np.broadcast_to(np.arange(len(self.points)), (len(some), len(self.points)))
            found = every if len(self.points) <= beam else search(self.graph, some, beam, self.marks)[0]
            for query, vector, nodes in zip(asked[a : a + SLICE], vectors[a : a + SLICE], found, strict=True):
                nodes = nodes[nodes >= 0]
                exact = self.points[nodes] @ vector
                hits = [(-s, m) for s, node in zip(exact.tolist(), nodes.tolist(), strict=True) for m in self.members[node] if m != query]
                out += [(query, m, -s) for s, m in sorted(hits)[:k]]
        ids, others, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.record_batch({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(others, pa.int64()), "score": pa.array(scores, pa.float64())})


def _searcher(k: int, beam: int):
    """For partitions sorted so that a shard's queries follow its graph: the graph is held, and the queries pass batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            is_graph = pc.is_valid(batch.column("points")).to_numpy(zero_copy_only=False)
            shard = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard")])
            cut = np.flatnonzero(np.concatenate([[True], (shard[:, 1:] != shard[:, :-1]).any(0) | is_graph[:-1] | is_graph[1:]])) if batch.num_rows else []
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if is_graph[a]:
                    held = _Held(part)
                else:
                    yield held.nearest(part, k, beam)

    return run


def _band(vector: Column) -> Column:
    """Which range of norms a vector is in, each ``NORMS`` binary orders wide; lengths about 1 are in the middle of one."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    norm = F.log2(top) + F.log2(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))) / 2
    return F.floor(norm / NORMS + 0.5).cast("int")


def neighbours(embeddings: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows with the largest inner product that were found.

    Both tables have (vec_id, embedding); a query isn't its own neighbour. The score is the
    inner product of the vectors as given, in double precision; equal scores go by vec_id.
    Rows whose id or vector is null, whose vector is empty, zero or has a null or non-finite
    component take no part. Vectors of different lengths don't meet. Rows with one vector are
    one node of a graph, of which the k + 1 smallest ids are kept: more can't be among k.
    Repeated ids are reported once, with their nearest vector; a repeated query id asks with
    its smallest vector. Empty tables give no rows; other columns are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))

    smallest = Window.partitionBy("vector").orderBy("vec_id")
    rows = clean(embeddings).distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    nodes = rows.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    nodes = materialize(nodes, "vectors")
    nodes = nodes.withColumn("band", _band(F.col("vector")))
    shards = nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    total = shards.agg(F.sum("shards")).first()[0] or 0
    shards = F.broadcast(shards) if total <= BROADCAST_ROWS else shards
    shard = lambda i: F.shiftleft(F.col("band").cast("long"), 32) + i
    placed = nodes.join(shards, ["dim", "band"]).withColumn("shard", shard(F.pmod(F.xxhash64("vector"), F.col("shards"))))
    kept = "dim int, shard long, points binary, edges binary, start int, members array<array<long>>"
    # Vectors are small but graphs are slow to build: partitions of a given number aren't merged by size, so each graph is a task.
    builders = min(BUILDERS, max(1, total))
    placed = placed.select("dim", "shard", "vector", "members").repartition(builders, "dim", "shard")
    graphs = materialize(placed.groupBy("dim", "shard").applyInArrow(_build_shard, kept), "graphs")
    asked = clean(queries).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector")).join(shards, "dim")
    every = F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), shard)).alias("shard")
    asked = asked.select("dim", every, F.col("vec_id").alias("query_id"), "vector")
    # A graph goes to one task, and after it the queries: nothing but a graph and a batch of queries is ever held.
    both = graphs.unionByName(asked, allowMissingColumns=True).repartition(builders, "dim", "shard")
    both = both.sortWithinPartitions("dim", "shard", F.col("points").isNull())
    bounded_batches(embeddings.sparkSession)
    found = both.mapInArrow(trimmed(_searcher(k, beam)), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
