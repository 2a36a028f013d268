"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item's set of word shingles is far smaller than a document's, so their Jaccard
similarity says little; what counts is how much of the item the document contains. The
MinHash sketch is therefore taken of the item alone, and its size follows from the item's:
items fall into partitions by their number of shingles, and a partition of sets of ``n``
keeps the ``n - ceil(share * n) + 1`` smallest hashes. A document that contains the wanted
share of an item lacks too few shingles to miss them all, so probing all of a document's
shingles against the sketches misses no item, however long the document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import materialize

#: Words in a shingle, share of an item's shingles that a document must contain.
K, SHARE = 5, (80, 100)
#: Sketch and candidate rows that may be broadcast (24 bytes each); beyond this Spark shuffles both sides.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; null text has none."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingles(words_: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order; none for fewer words."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words_) - k),
        lambda i: F.xxhash64(F.lit(k), *[F.get(words_, i + j) for j in range(k)]),
    )
    return F.when(F.size(words_) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, shingle, k, n): the distinct shingles of each item and their number; shorter items are one shingle of all their words."""
    w = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = F.least(F.size("w"), F.lit(k))
    hashes = F.coalesce(*[F.when(own == j, shingles(F.col("w"), j)) for j in range(1, k + 1)])
    rows = w.select("item_id", own.alias("k"), F.explode(hashes).alias("shingle")).distinct()
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def _hinted(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): each item of which a document contains at least ``share``.

    Words are runs of letters and digits in lower case, so case and punctuation don't hide an
    item; a shingle is ``k`` words, or a whole item of fewer. Null, empty and wordless texts
    are contained in nothing and contain nothing. Rows that repeat a doc_id or item_id count
    as one with all their texts' shingles. A null doc_id is reported like any other; null
    item_ids too. An empty table on either side gives no rows. Other columns are ignored.
    """
    num, den = share
    wanted = F.ceil(F.col("n") * F.lit(num) / F.lit(den))
    all_of = materialize(item_shingles(items, k), "items")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64(F.lit("sketch"), "shingle"), "shingle"))
    sketch = all_of.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - wanted + 1).select("item_id", "shingle")
    lengths = sorted(r.k for r in all_of.select("k").distinct().collect())  # at most k of them
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def spread(of: DataFrame) -> DataFrame:
        w = of.withColumn("w", words(F.col("text")))
        return w.select("doc_id", F.explode(F.flatten(F.array(F.array().cast("array<bigint>"), *[shingles(F.col("w"), j) for j in lengths]))).alias("shingle"))

    pairs = materialize(spread(docs).join(_hinted(sketch), "shingle").select("doc_id", "item_id").distinct(), "candidates")
    found_in = pairs.select(F.col("doc_id").alias("d")).distinct()
    again = docs.join(_hinted(found_in), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    hits = spread(again).join(_hinted(all_of), "shingle").select("doc_id", "item_id", "n", "shingle").distinct()
    hits = hits.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_shingles"), F.count("*").alias("n_found"))
    hits = hits.where(F.col("n_found") * den >= F.col("n_shingles") * num)
    pairs = pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    return hits.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
