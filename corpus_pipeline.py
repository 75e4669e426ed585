"""From raw documents to packed token sequences: quality rules, near and substring dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import curriculum, packing, probminhash, recompress, repetition
from claimweave.llm.queries import WORD_TOKENIZER, documents
from claimweave.session import materialize

_OWN = ("doc_id", "text", "source", "n_chars")


def _guarded(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an operator while all columns it does not know have names that cannot clash."""
    names = {name: f"__column_{i}" for i, name in enumerate(docs.columns) if name not in _OWN}
    return operator(docs.withColumnsRenamed(names)).withColumnsRenamed({new: old for old, new in names.items()})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""

    def rules(rows: DataFrame) -> DataFrame:
        return repetition.quality(rows).filter("kept").select(*rows.columns)

    return _guarded(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class."""
    return _guarded(docs, lambda rows: probminhash.keep_one(rows, probminhash.near_duplicates(rows)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur elsewhere; untouched texts stay as they are."""

    def rules(rows: DataFrame) -> DataFrame:
        found = recompress.remove_repeats(rows)
        text = F.when(F.col("n_removed") > 0, F.col("kept_words")).otherwise(F.col("text"))
        changed = found.withColumn("text", text)
        if "n_chars" in rows.columns:
            length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
            changed = changed.withColumn("n_chars", length.cast(rows.schema["n_chars"].dataType))
        return changed.select(*rows.columns)

    return _guarded(docs, rules)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum takes them, one row per copy, in order of their training positions."""
    return _guarded(docs, curriculum.training_order)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
