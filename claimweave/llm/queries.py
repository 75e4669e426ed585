"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import alignment, cotrain, curriculum, hard_negatives, imatch, language, line_dedup, orc_tokens, packing, probminhash, recompress, repetition, token_counts
from claimweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


@query
def op2_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(documents(spark, sf_dir)).drop("t1", "t2")


@query
def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(documents(spark, sf_dir))
    first = F.get(F.col("positions"), F.lit(0)).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first)


@query
def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


@query
def op7_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = recompress.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), end_id=0)


@query
def op9_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marks = cotrain.metadata(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    views = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), marks)
    return cotrain.score(docs, marks, views)


@query
def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orc-tokens")
    orc_tokens.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(WORD_TOKENIZER), end_id=2)
    return orc_tokens.read_digests(spark, path)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, over all vectors, with the labels of every seventh moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    infinite = F.lit(float("inf"))
    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == infinite))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = usable.select("vec_id", label.alias("label"), F.transform(x, lambda v: F.floor(v * 256)).alias("vector"))
    return hard_negatives.mine(whole, F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT ar, anchor_id, br AS pr, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY n.score DESC, n.vec_id, n.br) AS rank
  FROM positives p JOIN scored n ON p.ar = n.ar AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of a byte-level and a sentencepiece vocabulary, per document."""
    a, b = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    return alignment.align(documents(spark, sf_dir), a, b)


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them share."""
    kept = line_dedup.drop_frequent_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, u.position AS position, u.line AS line
  FROM texts, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, position)
), keyed AS (
  SELECT r, position, line,
    translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT r, position, line, key IN (SELECT key FROM frequent) AS gone FROM keyed
), joined AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM texts JOIN joined USING (r)
"""
