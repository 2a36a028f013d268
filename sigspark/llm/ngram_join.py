"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

How the whole join stays exact without comparing all pairs:

1. A pass over the texts gives each document's set of word shingles as sorted 64-bit hashes.
   Documents with one set form a class; only classes go on (copies of a text cost nothing).
2. Two sets that reach the threshold share ``spare(n)`` of the first ``n - need + spare(n)``
   shingles of one of them, whatever one global order puts first. The order takes shingles
   that many documents have last (counted over all rows by lossy counting), so that common
   passages link nothing. A class with fewer shared shingles than its smallest partner could
   ask for has no partner and goes; the others fall into one candidate component if they
   share such a shingle. From the second time on this is asked within each two neighbouring
   bands of sizes (see 3): what sets of other sizes share holds no link, and would by chance
   bring ever more of a growing table into one component.
3. A component is cut into tiles: bands of set sizes within the threshold's ratio of each
   other, and blocks of bounded size within a band; only tiles of one or neighbouring bands
   meet. In a tile, each set becomes a hashed bitmap; |A| minus the bits of A that B lacks
   bounds the overlap from above, and pairs under the bound go. The rest are intersected
   exactly. A tile returns counts and a spanning forest, never pairs.
4. The forests' components are the result. Where links needn't be counted, pairs that are
   connected already aren't compared, so many near copies of one text cost about as much each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import bounded_batches, discard, freed_shuffles, give_back, materialize, mix, settle, shingle_sets, skew_join, text_chunks, trimmed, utf8
from sigspark.llm.components import connected_components

#: Rows a batch counts together, times it must see a shingle to report it, and how many common shingles are kept for the order.
COUNT_AT, SEEN, COMMON = 16, 2, 500_000
#: One shingle in so many must be shared beyond the first, and so often is that asked.
SPARE, ASKED = 16, 2
#: Most rows (a key and an id) that are broadcast so that token lists or texts needn't be shuffled; beyond this they are.
FEW = 200_000
#: Classes and shingles in a block of a tile.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
#: Bits of a bitmap for each shingle of a tile's largest set, and most bits.
BITS_EACH, BITS = 2, 8192
#: Bytes of a tile's rows from which its process gives freed memory back.
LARGE_TILE = 1 << 20


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, count_links: bool = True) -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id, n_links, class_id).

    Words are runs of anything but ASCII white space with A-Z lowered; a document's set holds
    its distinct runs of ``k`` words, or all its words as one if they are fewer. Documents are
    linked if den * intersection >= num * union. ``n_links`` counts linked documents other
    than itself, ``class_id`` is the smallest doc_id with the same set, ``component_id`` the
    smallest reachable by links. Without ``count_links`` that column is left out, and pairs
    that are connected already needn't be compared: the other columns are the same.

    Null, empty and blank texts have no shingle and no link, and are their own component.
    Rows that repeat a doc_id each get a row, and count as one node. A row whose doc_id is
    null has no link, and no class or component. An empty table gives no rows. Columns other
    than doc_id and text are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    with freed_shuffles(docs.sparkSession):
        return _jaccard_join(docs, k, num, den, count_links)


def _jaccard_join(docs: DataFrame, k: int, num: int, den: int, count_links: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    common = _common_shingles(docs, k)
    sets = materialize(docs.mapInArrow(trimmed(_signer(k, num, den, common)), "doc_id long, n int, key binary, tokens array<long>, late array<long>"), "sets")
    rows = materialize(sets.select("doc_id", "n", "key"), "rows")
    keyed = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("weight"), F.count("*").alias("rows"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    once = sets.where("n > 0 AND doc_id IS NOT NULL")
    repeated, copied = classes.agg(F.count_if(F.col("rows") > F.col("weight")), F.count_if(F.col("rows") > 1)).first()
    if repeated:  # rows that repeat id and text would all be compared
        once = once.groupBy("doc_id", "key").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "late")])
    if copied <= FEW:
        copies = classes.where("rows > 1").select("key", "rep")
        firsts = once.join(F.broadcast(copies), "key", "left").where("rep IS NULL OR rep = doc_id").drop("rep")
    else:
        firsts = once.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"])
    firsts = firsts.where(F.col("n") * F.lit(den - num) >= num)  # smaller sets are linked with their equals only
    each = lambda c, late: firsts.select(F.col("doc_id").alias("rep"), "n", F.lit(0).alias("sizes"), F.explode(c).alias("token"), F.lit(late).alias("late"))
    shared = _shared(each("tokens", False), each("late", True))
    discard(sets)  # the token lists are the largest table
    settle(docs.sparkSession)
    least = spare(F.ceil(F.col("n") * F.lit(num) / F.lit(den)))
    for asked in range(ASKED):
        able = shared.groupBy("rep", "n", "sizes").agg(F.count("*").alias("c")).where(F.col("c") >= least)
        left = shared.join(able.select("rep", "sizes"), ["rep", "sizes"]).select("rep", "n", "sizes", "token", "late")
        if not asked:  # from here on only what a partner of a fitting size can share counts
            band = _size_band(num, den)
            left = left.withColumn("sizes", F.explode(F.array(band, band + 1)))
        old, shared = shared, _shared(left.where("NOT late"), left.where("late"))
        discard(old)
    near = connected_components(shared.where("rep != a").select("a", F.col("rep").alias("b")))
    discard(shared)
    members = materialize(classes.join(near.withColumnRenamed("node", "rep"), "rep").select("rep", "key", "n", "weight", F.col("root").alias("cell")), "members")
    settle(docs.sparkSession)
    if members.count() <= FEW:  # texts of others aren't shuffled
        docs = docs.join(F.broadcast(members.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    found = (_all_links if count_links else _enough_links)(docs, members, k, num, den)
    settle(docs.sparkSession)
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    result = result.select("key", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("key"))
    # Copies of one text may be a large part of all rows.
    rows = rows.select("doc_id", "n", named.alias("key"))
    met = skew_join(rows.where("key IS NOT NULL"), result, ["key"]).unionByName(rows.where("key IS NULL"), allowMissingColumns=True)
    counts = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return met.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *counts, F.coalesce("class_id", "doc_id").alias("class_id"))


def spare(n):
    """Shingles that a set of ``n`` and any linked set share among their first."""
    return 1 + (F.floor(n / SPARE) if not isinstance(n, int) else n // SPARE)


def _shared(firsts: DataFrame, late: DataFrame) -> DataFrame:
    """The rows (rep, n, sizes, token, late) whose token several of the same ``sizes`` have, with the smallest of these as ``a``.

    The tokens of ``late`` are the common ones: any that a large part of the documents has is
    among them, and there are at most ``COMMON``. Their groups are summed up on the map side
    and looked up by broadcast, so no task gets all rows of such a token.
    """
    same = Window.partitionBy("token", "sizes")
    rows = firsts.withColumn("a", F.min("rep").over(same)).withColumn("last", F.max("rep").over(same)).where("a != last").drop("last")
    groups = late.groupBy("token", "sizes").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a != last").drop("last")
    return materialize(rows.unionByName(late.join(F.broadcast(groups), ["token", "sizes"]).select(rows.columns)), "shared")


def needed(total, num: int, den: int):
    """Least overlap of two linked sets whose sizes sum to ``total``."""
    return -((-num * total) // (num + den))


def _common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of many documents, by lossy counting over all rows: each batch reports those it saw several times.

    Only the order of shingles depends on them, never the result, so the bound on their number loses nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= SEEN
            return pa.record_batch({"token": values[keep].view(np.int64), "seen": counts[keep]})

        for chunk in text_chunks(batches, "text"):
            held += shingle_sets(*utf8(chunk.column("text")), k)
            size += chunk.nbytes
            if size > COUNT_AT << 20:
                yield report()
                held, size = [], 0
        if held:
            yield report()

    seen = docs.select("text").mapInArrow(trimmed(count), "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = seen.orderBy(F.desc("seen"), "token").limit(COMMON).select("token")
    return np.sort(top.toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64))


def _signer(k: int, num: int, den: int, common: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            sets = shingle_sets(*utf8(chunk.column("text")), k)
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
            late = common[at] == flat if len(common) else np.zeros(len(flat), bool)
            keys, tokens, lates, begin = [], [], [], 0
            for s in sets:
                n = len(s)
                keys.append(np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for c in (1, 2)], np.uint64).tobytes())
                rare, often = s[~late[begin : begin + n]], s[late[begin : begin + n]]
                first = n - -(-num * n // den) + spare(n) if n else 0
                tokens.append(rare[:first].view(np.int64))
                lates.append(often[: max(0, first - len(rare))].view(np.int64))
                begin += n
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.record_batch({"doc_id": chunk.column("doc_id"), "n": pa.array(list(map(len, sets)), pa.int32()), "key": pa.array(keys, pa.binary()), "tokens": lists(tokens), "late": lists(lates)})

    return sign


def _blocks(c, m):
    return F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(m / BLOCK_SHINGLES)).cast("int")


def _size_band(num: int, den: int) -> Column:
    """A band is as wide as the ratio of sizes that a link allows, and a little wider against rounding: linked sets are in one band or the next."""
    step = math.log(den / num) * 1.000001
    return F.floor(F.log("n") / F.lit(step)).cast("int")


def _cut(members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (in shared storage) with band, block, unit and whether their cell is cut, and the groups (cell, band, g, blocks), all with an empty ``g``."""
    members = members.withColumn("size_band", _size_band(num, den))
    cell = Window.partitionBy("cell")
    bands = members.groupBy("cell", "size_band").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    # A component that fits in a block is one tile, in which sizes are compared; others are cut by band and hash.
    bands = bands.withColumn("cut", _blocks(F.sum("c").over(cell), F.sum("m").over(cell)) > 1)
    band, blocks = F.when(F.col("cut"), F.col("size_band")).otherwise(0), F.when(F.col("cut"), _blocks(F.col("c"), F.col("m"))).otherwise(1)
    bands = materialize(bands.select("cell", "size_band", "cut", band.alias("band"), blocks.alias("blocks")), "bands")
    members = skew_join(members, bands, ["cell", "size_band"]).withColumn("g", F.lit(""))
    return _in_units(members), bands.select("cell", "band", F.lit("").alias("g"), "blocks").distinct()


def _in_units(members: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return members.withColumn("unit", F.concat_ws("/", "cell", "band", "g", block))


def _tiles(groups: DataFrame) -> DataFrame:
    """(unit, unit2, tile) for all pairs of units that can hold links: of one cell, and of one band or neighbouring ones.

    A group with a name in ``g`` is connected already: its units don't meet each other.
    """
    other = groups.select("cell", F.col("band").alias("band2"), F.col("g").alias("g2"), F.col("blocks").alias("blocks2"))
    same = groups.join(other.withColumn("band", F.col("band2")), ["cell", "band"]).where("g2 >= g")
    up = groups.join(other.withColumn("band", F.col("band2") - 1), ["cell", "band"])
    pairs = same.unionByName(up).where("g = '' OR g != g2")
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    pairs = pairs.where("band != band2 OR g != g2 OR block2 >= block")
    pairs = pairs.select(F.concat_ws("/", "cell", "band", "g", "block").alias("unit"), F.concat_ws("/", "cell", "band2", "g2", "block2").alias("unit2"))
    return pairs.withColumn("tile", F.concat_ws("|", "unit", "unit2"))


def _check(docs: DataFrame, members: DataFrame, tiles: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(rep, peer, links): what each tile found for each of its classes."""
    roles = tiles.select("unit", "tile", F.lit(0).alias("side")).unionByName(tiles.where("unit != unit2").select(F.col("unit2").alias("unit"), "tile", F.lit(1).alias("side")))
    placed = members.join(roles, "unit").groupBy("rep", "key", "weight").agg(F.collect_list(F.struct("tile", "side")).alias("tiles"))
    texts = docs.join(placed, docs.doc_id == placed.rep)
    rows = texts.select("rep", "key", "weight", "text", F.explode("tiles").alias("t")).select("rep", "key", "weight", "text", "t.*")
    return materialize(rows.groupBy("tile").applyInArrow(_tile_checker(k, num, den), "rep long, peer long, links long"), "links")


def _all_links(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """What all tiles found: every link is counted."""
    members, groups = _cut(members, num, den)
    return _check(docs, members, _tiles(groups), k, num, den)


def _enough_links(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links that connect whatever links connect; in a cell of near copies the work grows as their number, not its square.

    First each unit is compared in itself. Of cells that are cut, the first member of each part
    found so is then compared with the others'. Last come the pairs of units that hold
    members not connected by then: parts that fill a unit get units of their own, which don't
    meet each other; all other units meet all. So no pair of unconnected members is left out.
    """
    members, _ = _cut(members, num, den)
    members = materialize(members, "units")
    alone = members.select("unit", F.col("unit").alias("unit2"), F.col("unit").alias("tile")).distinct()
    found = _check(docs, members, alone, k, num, den)
    cut = members.where("cut").select("rep", "key", "n", "weight", "cell", "band")
    if not cut.limit(1).count():
        return found
    texts = materialize(docs.join(cut.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "texts")

    def rooted(links: DataFrame) -> DataFrame:
        roots = connected_components(links.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
        return materialize(cut.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")

    heads = rooted(found).where("rep = root").drop("root", "band")
    found = found.unionByName(_all_links(texts, heads, k, num, den))
    parts = rooted(found)
    sizes = parts.groupBy("cell", "band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    sizes = materialize(sizes.withColumn("g", F.when(F.col("c") >= BLOCK_ROWS, F.col("root").cast("string")).otherwise("")), "sizes")
    groups = sizes.groupBy("cell", "band", "g").agg(_blocks(F.sum("c"), F.sum("m")).alias("blocks"))
    units = materialize(skew_join(sizes, groups, ["cell", "band", "g"]).select("cell", "band", "root", "g", "blocks"), "parts")
    placed = _in_units(skew_join(parts, units, ["cell", "band", "root"]))
    return found.unionByName(_check(texts, placed, _tiles(groups), k, num, den))


def _tile_checker(k: int, num: int, den: int):
    def check(table: pa.Table) -> pa.Table:
        ids, sides, keys, weights, sets = [], [], [], [], []
        for chunk in text_chunks(iter(table.to_batches()), "text"):
            for row, key, s in zip(range(chunk.num_rows), chunk.column("key").to_pylist(), shingle_sets(*utf8(chunk.column("text")), k), strict=True):
                mine = np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for c in (1, 2)], np.uint64).tobytes()
                if mine == key:  # rows that repeat the id with another text are not this class
                    ids.append(chunk.column("rep")[row].as_py())
                    sides.append(chunk.column("side")[row].as_py())
                    keys.append(key)
                    weights.append(chunk.column("weight")[row].as_py())
                    sets.append(s)
        first = np.unique(np.array([i.to_bytes(8, "big", signed=True) + key for i, key in zip(ids, keys, strict=True)], dtype="S24"), return_index=True)[1]
        ids, sides, weights = (np.array(x, np.int64)[first] for x in (ids, sides, weights))
        sets = [sets[i] for i in first]
        a, b = linked_pairs(sets, num, den, sides if sides.any() else None)
        links = np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
        root = np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        peers = ids[[find(x) for x in range(len(ids))]] if len(ids) else ids
        keep = links > 0
        if table.nbytes > LARGE_TILE:
            give_back()
        return pa.table({"rep": ids[keep], "peer": peers[keep], "links": links[keep].astype(np.int64)})

    return check


def linked_pairs(sets: list[np.ndarray], num: int, den: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all linked pairs of a tile, each once; with ``sides``, only those across the two sides."""
    if len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # By size: the partners of a set that are no smaller follow it, up to the largest size that a link allows.
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    sides = None if sides is None else sides[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    reach = np.searchsorted(sizes, sizes * den // num, "right")
    width = min(BITS, 1 << int(BITS_EACH * sizes.max() - 1).bit_length())
    bits = np.zeros((len(sets), width), np.float32)
    for row, s in zip(bits, sets, strict=True):
        row[(s % np.uint64(width)).astype(np.int64)] = 1
    set_bits = bits.sum(1)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out_a, out_b = [], []
    for i in range(len(sets)):
        if i % 128 == 0:
            top = reach[min(i + 127, len(sets) - 1)]
            both = bits[i : i + 128] @ bits[i:top].T  # bits that two bitmaps share
            base = i
        low, high = i + 1, reach[i]
        if low >= high:
            continue
        common = both[i - base, low - base : high - base]
        bound = np.minimum(sizes[i] - np.maximum(set_bits[i] - common, 0), sizes[low:high] - np.maximum(set_bits[low:high] - common, 0))
        ok = bound >= needed(sizes[i] + sizes[low:high], num, den)
        if sides is not None:
            ok &= sides[low:high] != sides[i]
        near = np.flatnonzero(ok) + low
        if not len(near):
            continue
        # Exact intersection of sorted arrays: each partner's shingles are looked up in this set's.
        every = len(near) * 4 > high - low
        some = np.arange(low, high) if every else near
        theirs = flat[starts[low] : starts[high]] if every else np.concatenate([sets[j] for j in near])
        mine = sets[i]
        hits = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        overlap = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
        near = some[(overlap >= needed(sizes[i] + sizes[some], num, den)) & (ok if every else True)]
        out_a.append(np.full(len(near), order[i]))
        out_b.append(order[near])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)
