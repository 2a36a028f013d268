"""The pipeline's stages take effect, in order, and keep their input's columns."""

import corpus_pipeline
from pyspark.sql import functions as F

from sigspark.llm import ngram_join
from sigspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "123", "en", None, 3)], docs.schema)
    docs, seen = docs.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen.append((name, docs.count(), out.count()))
        if name != "token_output":
            assert out.schema.names == docs.schema.names
        docs = out
    counts = {n: (a, b) for n, a, b in seen}
    assert list(counts) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_output"]
    assert counts["language_id"][0] - counts["language_id"][1] == 3
    assert counts["ngram_jaccard_join"][1] < counts["ngram_jaccard_join"][0]
    assert counts["token_output"][0] == counts["token_output"][1] > 0


def test_null_and_repeated_ids(spark, tmp_path):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, text("a")), (5, text("b")), (2, text("b")), (7, text("c")), (7, text("c")), (None, text("d")), (None, text("d")), (None, text("d") + " end")]
    rows += [(None, text("e")), (9, text("e")), (None, None), (None, None), (None, text("f")), (None, f"{text('g')} {item}"), (3, text("h")), (3, f"{text('i')} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ordered = lambda rows: sorted(rows, key=str)
    d = {text("d"), text("d") + " end"}
    for df in (docs, spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.union(docs)):
        times = 2 if df.count() > len(rows) else 1
        once = corpus_pipeline.ngram_jaccard_join(spark, df, str(tmp_path))
        assert once.schema == df.schema
        left = [tuple(r) for r in once.collect()]
        assert len([r for r in left if r[1] in d]) == 1
        kept = [(5, text("a")), (2, text("b")), (7, text("c")), (9, text("e")), *[(None, None)] * (2 * times)]
        kept += [(None, text("f")), (None, f"{text('g')} {item}"), (3, text("h")), (3, f"{text('i')} {item}")]
        assert ordered(r for r in left if r[1] not in d) == ordered(kept)
        clean = corpus_pipeline.benchmark_decontamination(spark, df, str(tmp_path))
        assert ordered(tuple(r) for r in clean.collect()) == ordered([r for r in rows if item not in (r[1] or "")] * times)


def test_far_sizes_are_not_compared(spark, monkeypatch):
    """The near-duplicate stage sends no text to a tile for shingles that it shares with texts of other sizes only."""
    seen, check = [], ngram_join._check
    monkeypatch.setattr(ngram_join, "_check", lambda docs, members, *rest: seen.append(members.select("cell").collect()) or check(docs, members, *rest))
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[: int(50 * 1.6**i)])) for i in range(8)] + [(100, " ".join([*words[:49], "end"]))]
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8))
    assert seen and all(sum(m.cell == n.cell for n in ms) <= 2 for ms in seen for m in ms)


def test_near_duplicates_settle_the_driver(spark):
    """The near-duplicate stage drops what its queries hold in the driver as it goes, and doesn't wait until the heap is full."""
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))
    words, before = " ".join(f"w{i}" for i in range(60)), full()
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, "other")], "doc_id long, text string")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, SF)
    assert full() - before >= 4
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(SQL) <= set(QUERIES)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.lit(1) for c in ("__row", "__file", "__at", "__n", "__id", "__times", "__drop", "___row", "group", "n", "key", "h", "rep", "token", "size", "taken")}
    read.limit(60).withColumns(clash).write.parquet(f"{tmp_path}/some")
    some = spark.read.parquet(f"{tmp_path}/some")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, some, SF).columns == some.columns and stage(spark, some, SF).count() > 0, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, read.limit(0), SF).count() == 0, name
