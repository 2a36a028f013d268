"""Mixing sources to target weights by random order, distributed prefix sums and an exact cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import WORD, materialize, numbered_copies, prefix_for, skew_join

#: Weights of the sources in code point order (null last), over and over; a target is at most so many times its source.
WEIGHTS, MOST = (5, 2, 1), 3
#: Ranges of the random keys that each source is sorted in; one is one task's window.
RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size), one row a source.

    Each source's share of all words follows its weight but is at most ``most`` times its
    own words, and what that cuts off goes to the others by weight, again and again. The end
    of this is target = min(weight * level, most * size) at the one level where the targets
    sum to all words; the sources that reach their bound are those with the least bound for
    their weight, so a sorted pass finds the level. The table has a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1))
    s = s.withColumn("bound", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("bound") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, everything = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.sum("bound").over(upto) + F.col("bound"))
    s = s.withColumn("level", F.col("rest") / (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")))
    # The level with all earlier sources at their bounds holds from the first source that doesn't reach its own.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)
    return s.select("source", "source_size", F.least(F.col("w") * level["level"], F.col("bound")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row a document: (doc_id, size, source_size, target, taken).

    ``size`` counts words. Each source is put in the order of md5(seed:doc_id), and its words
    are laid on end in that order, as many times as its target needs; ``taken`` is how many of
    the document's words lie before the target (rounded to whole words), repeats counted. So
    a source's taken words are its target exactly, and no document exceeds ``most`` times its
    size.

    The keys are uniform, so ranges of them are even parts of any source, however large: each
    range is summed apart, the sums are summed up by source, and only a range is ever sorted
    in one task. Rows that share id, source and size are counted first and dealt out again
    last, so an id that many rows have is as many rows as it has sizes. Null text has size 0 and is taken 0 times; null is a source of its own; null
    and repeated ids are ordered by size. An empty table gives no rows. Other columns are
    ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("key", key)
    rows = materialize(rows.withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * RANGES / (1 << 32)).cast("int")), "sized")
    words = F.sum(F.col("size") * F.col("copies"))
    parts = rows.groupBy("source", "part").agg(words.alias("n"))
    goal = targets(rows.groupBy("source").agg(words.alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(goal, parts.source.eqNullSafe(goal.source)).select(parts.source.alias("s"), F.col("part").alias("p"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(words.over(inside), F.lit(0)))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rows = numbered_copies(rows.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("base") - F.col("inside")), "copies", "copy")
    left = F.col("left") - F.col("copy") * F.col("size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: taken / size, to the nearest whole number.

    A document without words is kept once. Rows that share an id, null among them, share the
    sum of their parts: each is taken as often as all of them together are in the mean. An
    empty table gives no rows. ``docs`` is read several times; all its columns stay.
    """
    plan = mix_sources(docs, weights, most).groupBy("doc_id").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    times = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size"))).otherwise(1).cast("int")
    p = prefix_for(docs)
    key = lambda: (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(f"{p}id"), F.col("doc_id").isNull().alias(f"{p}none"))
    plan = plan.select(*key(), times.alias(f"{p}times")).where(F.col(f"{p}times") > 0)
    joined = skew_join(docs.select("*", *key()), plan, [f"{p}id", f"{p}none"])
    return joined.withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(0), F.col(f"{p}times")))).select(*docs.columns)
