"""Consistent-hash ring with virtual nodes and bounded loads: full shards pass keys on clockwise."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm.common import materialize, numbered_copies

#: Virtual nodes of each shard, and buckets of ring positions for the lookup.
VIRTUAL, BUCKETS = 512, 1 << 14
_BITS = 62


def _position(*columns):
    """A place on the ring, from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - _BITS)


def place(doc_id, text_crc32):
    """Where a document lies on the ring."""
    return _position(F.lit("key"), doc_id, text_crc32)


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, by position; their number is shards * virtual."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("long").alias("v"))
    return sorted((r.p, r.shard) for r in nodes.select(_position(F.lit("node"), "shard", "v").alias("p"), "shard").collect())


def pass_on(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Who takes which keys: (arc, first rank, end rank, shard, first slot).

    ``counts`` is the number of keys on each arc of the ring and ``owners`` the shard whose
    virtual node ends it. Capacities differ by one key at most and sum to the number of keys.
    In the first round each arc offers its keys to its owner; in each later round what is
    left goes on to the next virtual node clockwise, until all keys have a shard.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    arcs = len(owners)
    left = [(a, 0) for a in range(arcs) if counts[a]]
    out, hop = [], 0
    while left:
        still = []
        for a, rank in left:
            s = owners[(a + hop) % arcs]
            n = min(counts[a] - rank, room[s] - used[s])
            if n:
                out.append((a, rank, rank + n, s, used[s]))
                used[s] += n
            if rank + n < counts[a]:
                still.append((a, rank + n))
        left, hop = still, hop + 1
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    text = json.dumps([list(map(int, r)) for r in rows])
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    lists = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<array<bigint>>")).alias("r"))
    return lists.select(*[F.col("r")[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def assign_shards(docs: DataFrame, shards: int = 24, virtual: int = VIRTUAL) -> DataFrame:
    """One row a document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``rows``: numbers of rows per shard differ by one at most. A document lies on
    the ring at a hash of its id and its text's checksum; the arc it lies on belongs to the
    virtual node at its end. What a full shard can't take goes on clockwise, so a change in
    the number of shards moves what changes owner and what overflows, and nothing else.

    The driver sees one count for each arc (shards * virtual of them, whatever the input) and
    decides by arcs and ranks; the rows are ranked in their arcs and joined to that table,
    which has at most a few entries for each arc and shard. Rows that are equal in all that
    is returned are counted before they are ranked and dealt out again afterwards, so that no
    task holds a large group of them.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8, ``text_crc32`` the crc32 of those
    bytes (null as empty). ``slot`` counts a shard's rows from 0 without gaps. Null ids are an
    id like any other; rows that share an id are parted by their texts, and equal rows lie at
    one place and have ranks of their own. An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, virtual)
    positions = [p for p, _ in nodes]
    width = 1 << (_BITS - BUCKETS.bit_length() + 1)
    lookup, arcs = [], len(nodes)
    for bucket in range(BUCKETS):
        low, end = bucket * width, (bucket + 1) * width
        at = bisect.bisect_left(positions, low)
        while at < arcs and positions[at] < end - 1:
            lookup.append((bucket, low, positions[at], at))
            low, at = positions[at] + 1, at + 1
        lookup.append((bucket, low, end - 1, at % arcs))
    lookup_table = F.broadcast(_table(spark, lookup, "bucket int,low long,high long,arc int"))

    doc_id = F.col("doc_id").cast("long")
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(bytes_) + 8).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("position", place("doc_id", "text_crc32")), "rows")
    rows = rows.withColumn("bucket", F.floor(F.col("position") / F.lit(width)).cast("int"))
    rows = rows.join(lookup_table, "bucket").where("position BETWEEN low AND high").drop("bucket", "low", "high")
    counts = [0] * arcs
    for r in rows.groupBy("arc").agg(F.sum("copies").alias("n")).collect():
        counts[r.arc] = r.n
    shares = F.broadcast(_table(spark, pass_on(counts, [s for _, s in nodes], shards), "arc int,first long,end long,shard int,base long"))
    upto = Window.partitionBy("arc").orderBy("position", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("until", F.sum("copies").over(upto)).withColumn("since", F.col("until") - F.col("copies"))
    # The ranks since .. until of a row's copies may be shared by several shards.
    placed = rows.join(shares, "arc").where((F.col("since") < F.col("end")) & (F.col("until") > F.col("first")))
    low = F.greatest("since", "first")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + low - F.col("first")).alias("start"), (F.least("until", "end") - low).alias("taken"))
    placed = numbered_copies(placed, "taken", "copy")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
