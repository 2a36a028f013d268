"""The queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import ann, chat, decontaminate, langid, mixing, ngram_join, pii, sharding, token_files, toxicity
from sigspark.llm.common import shared_path

VOCABULARY = "word_bpe_49k.json"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(control)))


def op2_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ann_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op4_pii_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), 4, 85, 100)


def op7_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return token_files.digests(token_files.read_tokens(spark, path))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold_of(4) == 2, F.lit(False))
    found = langid.identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_target_chat,
        op2_toxicity_nb_ngrams,
        op3_ann_pruned_graph,
        op4_pii_bootstrapped,
        op5_bounded_ring_shards,
        op6_ngram_jaccard_join,
        op7_orc_token_files,
        op8_language_id,
        op9_mix_sources,
        op10_decontaminate,
        pipeline,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

SQL = {
    "op1_prefix_target_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
h AS (SELECT *, '<|im_start|>' || replace({_ESCAPED.format("role")}, chr(10), '<|nl|>') || chr(10) AS head FROM t),
p AS (SELECT *, head || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS piece FROM h),
f AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS context FROM p)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_examples,
  CAST(coalesce(sum(context) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM f GROUP BY conv_id""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS h FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x, min(y) AS c FROM r GROUP BY x),
m AS (SELECT x, count(*) AS c FROM l GROUP BY x),
q AS (SELECT h, min(doc_id) AS d FROM n GROUP BY h)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.c, w.doc_id) AS component_id, CAST(coalesce(m.c, 0) AS BIGINT) AS n_links, coalesce(q.d, w.doc_id) AS class_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.x = w.doc_id LEFT JOIN m ON m.x = w.doc_id LEFT JOIN q ON q.h = n.h""",
    "op9_mix_sources": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
b AS (SELECT *, source_size * 3.0::DOUBLE AS bound, source_size * 3.0::DOUBLE / w AS ratio FROM s),
v AS (SELECT *, ((SELECT sum(source_size) FROM b) - sum(bound) OVER o + bound) / ((SELECT sum(w) FROM b) - sum(w) OVER o + w) AS level FROM b
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(w * (SELECT arg_min(level, (ratio, source)) FROM v WHERE level <= ratio), bound) AS target FROM v),
c AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM c""",
    "op10_decontaminate": f"""
WITH i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
k AS (SELECT item_id, w, CAST(least(len(w), 5) AS BIGINT) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) AS sh FROM k),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
e AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda j: array_to_string(w[j:j+k-1], ' '))) AS sh FROM d CROSS JOIN (SELECT DISTINCT k FROM k))
SELECT e.doc_id, s.item_id, CAST(max(n.n) AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found
FROM e JOIN s ON e.k = s.k AND e.sh = s.sh JOIN n ON n.item_id = s.item_id
GROUP BY e.doc_id, s.item_id HAVING count(*) * 100 >= max(n.n) * 80""",
}
