"""Retention, access and promotion checks over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators.scale import first_reason


@dataclass(frozen=True)
class RetentionPolicy:
    derived_artifact_days: int = 30
    raw_input_retained: bool = False


@dataclass(frozen=True)
class AccessPolicy:
    provider_allowlist: Sequence[str]
    require_zero_retention: bool = True
    require_deidentified_input: bool = True
    allow_prompt_telemetry: bool = False
    max_input_characters: int = 250_000


def retention_violations(artifacts: DataFrame, policy: RetentionPolicy = RetentionPolicy()) -> DataFrame:
    """Derived artifacts that hold raw input although the policy forbids it."""
    return artifacts.filter(F.coalesce("contains_raw_input", F.lit(True)) & F.lit(not policy.raw_input_retained))


def access_violations(requests: DataFrame, policy: AccessPolicy) -> DataFrame:
    """Refused requests with the first reason that applies; what is not known to be allowed is refused."""
    size = F.col("input_characters")
    reason = first_reason(
        provider_not_allowlisted=~F.coalesce(F.col("provider").isin(*policy.provider_allowlist), F.lit(False)),
        not_deidentified=F.lit(policy.require_deidentified_input) & ~F.coalesce("deidentified", F.lit(False)),
        retention_enabled=F.lit(policy.require_zero_retention) & ~F.coalesce("zero_retention", F.lit(False)),
        telemetry_enabled=F.lit(not policy.allow_prompt_telemetry) & F.coalesce("telemetry_enabled", F.lit(True)),
        input_too_large=~F.coalesce(size.between(0, policy.max_input_characters), F.lit(False)),
    )
    return requests.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def promotable(proposals: DataFrame, min_precision: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Proposals with a reviewer, enough precision and a rule; recall is recorded, not gated."""
    reason = first_reason(
        no_reviewer=text.is_blank(F.col("reviewer_id")),
        precision_too_low=~F.coalesce(F.col("evaluation_precision") >= min_precision, F.lit(False)),
        no_rule=text.is_blank(F.col("proposed_rule")),
    )
    checked = proposals.withColumn("reason", reason)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())
