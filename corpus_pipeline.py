"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import decontaminate, langid, mixing, ngram_join, token_files
from sigspark.llm.common import materialize, prefix_for, settle, shared_path

#: SQL can express neither a language model, nor the reading of token files.
ORACLE_SQL = None
#: Words that an encoder process keeps: fewer than it would alone, as the session's earlier stages have filled their executors.
REMEMBERED = 60_000
#: Where a row stands in its Parquet file.
PLACE = "_metadata.file_path", "_metadata.row_index"
#: Ids of rows to drop that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, the same however often the rows are read (a file's number and the row's in it), and that column's name.

    The name is none of ``docs``'s own. An empty table stays empty.
    """
    p = prefix_for(docs)
    place = [f"{source} AS {p}{name}" for source, name in zip(PLACE, ("file", "at"), strict=True)]
    try:
        # Of a plan that does more than read files several rows can come from one place of a file.
        placed = docs.selectExpr("*", *place) if docs._jdf.queryExecution().analyzed().children().isEmpty() else None
    except AnalysisException:  # not of Parquet files
        placed = None
    if placed is None:
        placed = materialize(docs, "rows").selectExpr("*", *place)
    names = sorted(r[0] for r in placed.select(f"{p}file").distinct().collect())  # as many as the driver listed to read them
    files = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{p}file string, {p}n long")
    row = F.shiftleft(f"{p}n", 40) + F.col(f"{p}at")
    return placed.join(F.broadcast(files), f"{p}file").select(*docs.columns, row.alias(f"{p}row")), f"{p}row"


def _texts(keyed: DataFrame, row: str) -> DataFrame:
    """(doc_id, text) for an operator, where the number of a row stands for its id: no two rows share one and none is null."""
    return keyed.select(F.col(row).alias("doc_id"), "text")


def _without(keyed: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose number is no doc_id of ``rows`` (which may repeat), without the number; all of them if ``rows`` is empty."""
    rows = materialize(rows.select(F.col("doc_id").alias(row)).distinct(), "dropped")
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return keyed.join(rows, row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no learned language: without a letter, or with no language for a third of their letters.

    Null and empty texts are dropped; rows that repeat are each judged alike. All columns stay.
    """
    return langid.accept(docs, docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by 5-word shingles at a similarity of 0.8: that with the smallest id, or one without if none has an id.

    Rows are judged by their texts, whatever their ids: repeated rows and null ids are rows
    like any other. Texts without a word are linked with nothing and stay. All columns stay.
    """
    keyed, row = _keyed(docs)
    found = ngram_join.jaccard_join(_texts(keyed, row), 5, 80, 100).where("n_links > 0")
    linked = materialize(found.select("doc_id", F.col("component_id").alias("group")), "linked")
    settle(spark)
    ids = keyed.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))
    kept = linked.join(ids, "doc_id").groupBy("group").agg(first.alias("first")).select(F.col("first.doc_id").alias("doc_id"))
    return _without(keyed, row, linked.join(kept, "doc_id", "left_anti"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text contains a benchmark item (0.8 of its 5-word shingles), whatever their ids. Null and empty texts stay, and so do all columns."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, row = _keyed(docs)
    return _without(keyed, row, decontaminate.contained_items(_texts(keyed, row), items))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; texts without a word once. Rows that share an id, null among them, are taken equally often."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files, and what is read back from them: doc_id, start, n_tokens, ids_crc32. A row for each row; null texts have the end id alone."""
    path = shared_path(spark, "tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), REMEMBERED)
    return token_files.digests(token_files.read_tokens(spark, path))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mix_to_weights),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
