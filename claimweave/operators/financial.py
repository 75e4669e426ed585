"""Claim lines, denials and remittances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators.checks import duplicates, unknown_references
from claimweave.operators.scale import reasons, split_checked


def _array_repeats(values: Column) -> Column:
    return F.size(values) != F.size(F.array_distinct(values))


def check_lines(lines: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Unique line ids, texts present, positive units and amounts that are not negative."""
    repeated = duplicates(lines, [scope, "line_id"]).select(scope, "line_id", F.lit(True).alias("_repeated"))
    checked = (
        lines.join(repeated, [scope, "line_id"], "left")
        .withColumn(
            "violations",
            reasons(
                duplicate_line=F.col("_repeated"),
                blank_field=text.is_blank(F.col("line_id")) | text.is_blank(F.col("code")) | text.is_blank(F.col("status")),
                units_not_positive=F.col("units").isNull() | (F.col("units") <= 0),
                negative_charge=F.col("charged_amount_cents").isNull() | (F.col("charged_amount_cents") < 0),
                negative_allowed=F.col("allowed_amount_cents") < 0,
            ),
        )
        .drop("_repeated")
    )
    return split_checked(checked)


def check_denials(denials: DataFrame, lines: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Denials name unique, known lines and carry an amount that is null or not negative."""
    key = [scope, "denial_id"]
    unknown = (
        unknown_references(denials, key, F.col("line_ids"), lines, ["line_id"], scope=[scope])
        .select(*key, F.lit(True).alias("_unknown"))
        .distinct()
    )
    checked = (
        denials.join(unknown, key, "left")
        .withColumn(
            "violations",
            reasons(
                no_lines=F.size("line_ids") == 0,
                duplicate_lines=_array_repeats(F.col("line_ids")),
                unknown_line=F.col("_unknown"),
                negative_amount=F.col("amount_cents") < 0,
            ),
        )
        .drop("_unknown")
    )
    return split_checked(checked)


def check_remittances(remittances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Amounts that are not negative and unique denial ids; whether they exist is not checked."""
    checked = remittances.withColumn(
        "violations",
        reasons(
            negative_payment=F.col("paid_amount_cents").isNull() | (F.col("paid_amount_cents") < 0),
            negative_adjustment=F.col("adjustment_amount_cents").isNull() | (F.col("adjustment_amount_cents") < 0),
            duplicate_denials=_array_repeats(F.col("denial_ids")),
        ),
    )
    return split_checked(checked)


def denied_amounts(denials: DataFrame, scope: str) -> DataFrame:
    """Denied cents per encounter; an unknown amount counts as zero."""
    return denials.groupBy(scope).agg(
        F.sum(F.coalesce("amount_cents", F.lit(0))).cast("bigint").alias("denied_amount_cents"),
        F.count(F.lit(1)).alias("denials"),
    )
