"""Predicates: the row filter of a mapping and the two-valued rule conditions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_predicate(conditions: Sequence[Mapping[str, Any]]) -> Column:
    """AND of ``eq, not_eq, in, not_in, present, not_present``; null differs from any value."""
    result = F.lit(True)
    for condition in conditions:
        column, op, value = F.col(condition["field"]), condition["op"], condition.get("value")
        if op in ("present", "not_present"):
            present = column.isNotNull() & (column.cast("string") != "")
            test = present if op == "present" else ~present
        elif op in ("eq", "not_eq"):
            equal = column.eqNullSafe(F.lit(value))
            test = equal if op == "eq" else ~equal
        elif op in ("in", "not_in"):
            member = reduce(lambda a, b: a | b, [column.eqNullSafe(F.lit(v)) for v in value], F.lit(False))
            test = member if op == "in" else ~member
        else:
            raise ValueError(f"unsupported row condition: {op}")
        result = result & test
    return result


def row_filter(df: DataFrame, conditions: Sequence[Mapping[str, Any]]) -> DataFrame:
    return df.filter(row_predicate(conditions)) if conditions else df


@dataclass(frozen=True)
class Typed:
    """A resolved field: its column and one of string, number, boolean, array, map, variant."""

    column: Column
    kind: str


Resolver = Callable[[str], Typed | None]


def variant_path(value: Column, path: str) -> Typed:
    """A dotted path inside an open map; a missing step and a JSON null give null."""
    found = F.try_variant_get(value, "$." + path, "variant")
    return Typed(F.when(~F.is_variant_null(found), found), "variant")


def compile_condition(tree: Mapping[str, Any], resolve: Resolver) -> Column:
    """Boolean column that is never null.

    Every leaf is made two-valued before ``not`` sees it, so the negation of a
    comparison with an absent field is true.
    """
    if "all" in tree:
        return reduce(lambda a, b: a & b, [compile_condition(item, resolve) for item in tree["all"]])
    if "any" in tree:
        return reduce(lambda a, b: a | b, [compile_condition(item, resolve) for item in tree["any"]])
    if "not" in tree:
        return ~compile_condition(tree["not"], resolve)
    op, expected = tree["op"], tree.get("value")
    actual = resolve(tree["field"])
    if op == "exists":
        present = F.lit(False) if actual is None else actual.column.isNotNull()
        return ~present if expected is False else present
    if actual is None:
        return F.lit(False)
    return F.coalesce(_leaf(actual, op, expected), F.lit(False))


def _leaf(actual: Typed, op: str, expected: Any) -> Column:
    present = actual.column.isNotNull()
    if op == "eq":
        return _equals(actual, expected)
    if op == "ne":
        return present & ~F.coalesce(_equals(actual, expected), F.lit(False))
    if op == "in":
        if not isinstance(expected, (list, tuple)):
            return F.lit(False)
        return reduce(
            lambda a, b: a | b,
            [F.coalesce(_equals(actual, item), F.lit(False)) for item in expected],
            F.lit(False),
        )
    if op in ("contains", "not_contains"):
        contains = F.coalesce(_contains(actual, expected), F.lit(False))
        return contains if op == "contains" else present & ~contains
    if op in ("gte", "lte"):
        return _ordered(actual, op, expected)
    raise ValueError(f"unsupported operator: {op}")


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _variant_as(actual: Typed, kind: str) -> Column:
    """The variant's value as ``kind`` when it really has that type, else null."""
    name = F.schema_of_variant(actual.column)
    if kind == "number":
        test, target = name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "double"
    elif kind == "boolean":
        test, target = name == "BOOLEAN", "boolean"
    elif kind == "string":
        test, target = name == "STRING", "string"
    elif kind == "array":
        test, target = F.startswith(name, F.lit("ARRAY")), "array<variant>"
    else:
        test, target = F.startswith(name, F.lit("OBJECT")), "map<string,variant>"
    return F.when(test, F.try_variant_get(actual.column, "$", target))


def _as(actual: Typed, kind: str) -> Column | None:
    if actual.kind == "variant":
        return _variant_as(actual, kind)
    return actual.column if actual.kind == kind else None


def _equals(actual: Typed, expected: Any) -> Column:
    kind = "boolean" if isinstance(expected, bool) else "number" if _is_number(expected) else "string"
    if expected is None or isinstance(expected, (list, tuple, Mapping)):
        return F.lit(False)
    column = _as(actual, kind)
    return F.lit(False) if column is None else column == F.lit(expected)


def _contains(actual: Typed, expected: Any) -> Column:
    tests = []
    if isinstance(expected, str):
        text, entries = _as(actual, "string"), _as(actual, "map")
        if text is not None:
            tests.append(F.contains(text, F.lit(expected)))
        if entries is not None:
            tests.append(F.map_contains_key(entries, expected))
    if actual.kind == "variant":
        items = _variant_as(actual, "array")
        tests.append(F.exists(items, lambda item: F.coalesce(_equals(Typed(item, "variant"), expected), F.lit(False))))
    elif actual.kind == "array":
        tests.append(F.array_contains(actual.column, expected))
    return F.coalesce(*tests, F.lit(False)) if tests else F.lit(False)


def _ordered(actual: Typed, op: str, expected: Any) -> Column:
    if isinstance(expected, bool) or not isinstance(expected, (int, float, str)):
        return F.lit(False)
    column = _as(actual, "number" if _is_number(expected) else "string")
    if column is None:
        return F.lit(False)
    return column >= F.lit(expected) if op == "gte" else column <= F.lit(expected)
