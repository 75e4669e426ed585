"""Referential, uniqueness, budget and grounding checks; failures become rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators.scale import count_per_key, reasons, split_checked, split_rejects

# Size limits of one case and of one source bundle.
CASE_LIMITS = {
    "evidence": {"max_items": 2_000, "max_characters": 2_000, "max_total_characters": 250_000},
    "entities": {"max_items": 2_000},
    "relations": {"max_items": 5_000},
    "assertions": {"max_items": 2_000},
}
DOCUMENT_LIMITS = {"max_items": 200, "max_characters": 200_000, "max_total_characters": 1_000_000}


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows (``copies``)."""
    return count_per_key(df, keys, "copies").filter(F.col("copies") > 1)


def overlap(supporting: Column, contradicting: Column) -> Column:
    """True when an item is cited both for and against."""
    return F.coalesce(F.arrays_overlap(supporting, contradicting), F.lit(False))


def unknown_references(
    df: DataFrame, keys: Sequence[str], references: Column, target: DataFrame, target_keys: Sequence[str], scope: Sequence[str] = ()
) -> DataFrame:
    """One row per reference in an array column that the target table does not hold.

    ``scope`` columns (a case id, say) must agree on both sides.
    """
    cited = df.select(*dict.fromkeys([*scope, *keys]), F.explode(references).alias("reference"))
    known = target.select(*scope, *[F.col(key).alias("reference") for key in target_keys]).distinct()
    return cited.join(known, [*scope, "reference"], "left_anti")


def orphans(children: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    return children.join(parents.select(*on), list(on), "left_anti")


def budget_usage(df: DataFrame, scope: Sequence[str], body: str | None = None) -> DataFrame:
    """Items and characters per scope, all combined map-side."""
    measures = [F.count(F.lit(1)).alias("items")]
    if body:
        measures += [
            F.coalesce(F.max(F.length(body)), F.lit(0)).cast("bigint").alias("longest"),
            F.coalesce(F.sum(F.length(body)), F.lit(0)).cast("bigint").alias("characters"),
        ]
    return df.groupBy(*scope).agg(*measures)


def check_budget(usage: DataFrame, limits: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """Scopes within and beyond the limits of a policy."""
    checks = {"max_items": F.col("items") > limits["max_items"]}
    if "max_characters" in limits:
        checks["max_characters"] = F.col("longest") > limits["max_characters"]
    if "max_total_characters" in limits:
        checks["max_total_characters"] = F.col("characters") > limits["max_total_characters"]
    return split_rejects(usage, reasons(**checks))


def check_grounding(evidence: DataFrame, documents: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return split_checked(checked_grounding(evidence, documents, scope))


def checked_grounding(evidence: DataFrame, documents: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Evidence must quote its document word for word and keep its metadata.

    Both sides carry ``scope`` and ``document_id``; the whole document text is searched.
    """
    source = documents.select(
        *scope,
        "document_id",
        F.col("author_role").alias("_role"),
        F.col("recorded_at").alias("_recorded"),
        F.col("text").alias("_source"),
        F.lit(True).alias("_known"),
    )
    joined = evidence.join(source, [*scope, "document_id"], "left")
    known = F.col("_known").isNotNull()
    return joined.withColumn(
        "violations",
        reasons(
            carries_locator=F.col("source_locator").isNotNull() if "source_locator" in evidence.columns else F.lit(False),
            unknown_document=~known,
            metadata_changed=known
            & ~(F.col("author_role").eqNullSafe(F.col("_role")) & F.col("recorded_at").eqNullSafe(F.col("_recorded"))),
            not_an_excerpt=known & ~F.contains(F.col("_source"), F.col("text")),
        ),
    ).drop("_role", "_recorded", "_source", "_known")


def check_locators(evidence: DataFrame, provenance: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A locator needs the case's ingestion provenance and the same adapter and version."""
    ingestion = provenance.select(
        *scope, F.col("adapter_id").alias("_adapter"), F.col("adapter_version").alias("_version"), F.lit(True).alias("_known")
    )
    joined = evidence.join(ingestion, list(scope), "left")
    located = F.col("source_locator").isNotNull()
    known = F.col("_known").isNotNull()
    checked = joined.withColumn(
        "violations",
        reasons(
            locator_without_provenance=located & ~known,
            locator_mismatch=located
            & known
            & ~(
                F.col("source_locator.adapter_id").eqNullSafe(F.col("_adapter"))
                & F.col("source_locator.adapter_version").eqNullSafe(F.col("_version"))
            ),
        ),
    ).drop("_adapter", "_version", "_known")
    return split_checked(checked)


def check_assertions(
    assertions: DataFrame, entities: DataFrame, evidence: DataFrame, case: str = "case_id"
) -> tuple[DataFrame, DataFrame]:
    """Lineage of assertions: unique id, known subject, cited and known evidence, no overlap."""
    key = [case, "assertion_id"]
    repeated = duplicates(assertions, key).select(*key, F.lit(True).alias("_repeated"))
    subjects = entities.select(case, F.col("entity_id").alias("subject_id"), F.lit(True).alias("_subject")).distinct()
    cited = F.concat(
        F.coalesce("evidence_ids", F.array().cast("array<string>")),
        F.coalesce("contradicting_evidence_ids", F.array().cast("array<string>")),
    )
    unknown = (
        unknown_references(assertions, key, cited, evidence, ["evidence_id"], scope=[case])
        .select(*key, F.lit(True).alias("_unknown"))
        .distinct()
    )
    joined = (
        assertions.join(repeated, key, "left").join(unknown, key, "left").join(subjects, [case, "subject_id"], "left")
    )
    checked = joined.withColumn(
        "violations",
        reasons(
            duplicate_id=F.col("_repeated"),
            unknown_subject=F.col("_subject").isNull(),
            no_evidence=F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0,
            overlap=overlap(F.col("evidence_ids"), F.col("contradicting_evidence_ids")),
            unknown_evidence=F.col("_unknown"),
        ),
    ).drop("_repeated", "_unknown", "_subject")
    return split_checked(checked)


def check_interval(df: DataFrame, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """Start must not come after end; instants are compared, not texts."""
    return split_rejects(df, reasons(ends_before_start=start > end))


def check_paths(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Relative source paths: no absolute path, parent step, home or backslash."""
    value = F.col(path)
    return split_rejects(
        df,
        reasons(
            blank_path=text.is_blank(value),
            unsafe_path=value.rlike(r"^/|\\|(^|/)\.\.(/|$)|^~"),
        ),
    )


def unknown_names(references: Column, known: Column) -> Column:
    """Referenced names (columns, resources, classes) that are not known, in order."""
    return F.array_sort(F.array_except(references, known))


def matching_definitions(runs: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status gate: run and bound definition must be approved, and the definition must exist with equal digest."""
    bound = definitions.select(
        F.col("ontology_id"), F.col("version"), F.col("digest").alias("_digest"), F.col("status").alias("_status")
    )
    joined = runs.join(bound, ["ontology_id", "version"], "left")
    checked = joined.withColumn(
        "violations",
        reasons(
            not_executable=~F.coalesce(F.col("status").isin("approved", "approved-for-demo"), F.lit(False)),
            unknown_definition=F.col("_digest").isNull(),
            definition_not_executable=F.col("_digest").isNotNull() & ~F.coalesce(F.col("_status").isin("approved", "approved-for-demo"), F.lit(False)),
            digest_mismatch=F.col("_digest").isNotNull() & ~F.col("_digest").eqNullSafe(F.col("digest")),
        ),
    ).drop("_digest", "_status")
    return split_checked(checked)
