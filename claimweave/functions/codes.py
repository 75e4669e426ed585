"""Claim code lists: hypothetical changes, grouping and pricing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLECTIONS = ("diagnoses", "procedures", "charges")


def apply_change(codes: Column, add: Column, remove: Column | None = None) -> Column:
    """Remove codes, then append those not yet present; order and the source list stay."""
    kept = codes if remove is None else F.filter(codes, lambda code: ~F.array_contains(remove, code))
    return F.concat(kept, F.array_distinct(F.filter(add, lambda code: ~F.array_contains(kept, code))))


@dataclass(frozen=True)
class PriceRule:
    """``pattern`` is an exact code, a prefix followed by ``%``, or null for any claim."""

    priority: int
    pattern: str | None
    group: str
    cents: int


#: Fixed demonstration values: group and price by diagnosis.
DEMO_PRICE_RULES = (
    PriceRule(1, "L89.154", "DEMO-290", 1_842_000),
    PriceRule(2, "L89%", "DEMO-291", 1_280_000),
    PriceRule(3, None, "DEMO-292", 1_000_000),
)
DEMO_GROUPER_VERSION = "demo-0.2-not-for-billing"


def _applies(rule: PriceRule, diagnoses: Column) -> Column:
    if rule.pattern is None:
        return F.lit(True)
    if rule.pattern.endswith("%"):
        prefix = rule.pattern[:-1]
        return F.exists(diagnoses, lambda code: F.startswith(code, F.lit(prefix)))
    return F.array_contains(diagnoses, rule.pattern)


def group_and_price(
    diagnoses: Column,
    rules: Sequence[PriceRule] = DEMO_PRICE_RULES,
    version: str = DEMO_GROUPER_VERSION,
) -> Column:
    """``struct(group, cents, version)`` of the first rule that applies, row by row."""
    ordered = sorted(rules, key=lambda rule: rule.priority)
    results = [
        F.when(
            _applies(rule, diagnoses),
            F.struct(
                F.lit(rule.group).alias("group"),
                F.lit(rule.cents).cast("bigint").alias("cents"),
                F.lit(version).alias("version"),
            ),
        )
        for rule in ordered
    ]
    return reduce(lambda first, second: F.coalesce(first, second), results)
