"""Joining child tables to encounters, claims and their code collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.scale import count_per_key, reasons, split_rejects


def attach_children(
    parents: DataFrame, children: DataFrame, on: str, unique: str
) -> tuple[DataFrame, DataFrame]:
    """Child rows of known parents; unknown parents and repeated child ids are rejects."""
    known = parents.select(F.col(on), F.lit(True).alias("_known"))
    repeated = (
        count_per_key(children, [on, unique]).filter(F.col("_count") > 1).select(on, unique, F.lit(True).alias("_repeated"))
    )
    joined = children.join(repeated, [on, unique], "left").join(known, on, "left")
    ok, rejects = split_rejects(
        joined, reasons(unknown_parent=F.col("_known").isNull(), duplicate_id=F.col("_repeated"))
    )
    return ok.drop("_known", "_repeated"), rejects.drop("_known", "_repeated")


def missing_claims(encounters: DataFrame, claims: DataFrame, on: str) -> DataFrame:
    return encounters.join(claims.select(on), on, "left_anti")


def multiple_claims(claims: DataFrame, on: str) -> DataFrame:
    return count_per_key(claims, [on], "claim_rows").filter(F.col("claim_rows") > 1)


def attach_claims(encounters: DataFrame, claims: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Exactly one claim row per encounter; encounters with none or several are rejects."""
    counts = count_per_key(claims, [on], "_claims")
    counted = encounters.join(counts, on, "left")
    checked = counted.withColumn(
        "violations",
        reasons(missing_claim=F.col("_claims").isNull(), multiple_claims=F.col("_claims") > 1),
    ).drop("_claims")
    single = checked.filter(F.size("violations") == 0).drop("violations")
    extra = [name for name in claims.columns if name == on or name not in encounters.columns]
    return single.join(claims.select(*extra), on, "inner"), checked.filter(F.size("violations") > 0)


def distinct_codes(df: DataFrame, on: str, value: str, row_number: str) -> DataFrame:
    """One row per encounter and code with the first row number it was seen at."""
    return df.groupBy(on, value).agg(F.min(row_number).alias("first_row"))


def collect_codes(df: DataFrame, on: str, value: str, row_number: str, name: str) -> DataFrame:
    """Distinct codes of each encounter as an array in first-seen order.

    Repeats are removed by an aggregate before anything is gathered, so an array
    is bounded by the code vocabulary and not by the encounter's rows.
    """
    pairs = F.array_sort(F.collect_list(F.struct("first_row", value)))
    gathered = distinct_codes(df, on, value, row_number).groupBy(on).agg(pairs.alias("_pairs"))
    return gathered.select(on, F.transform("_pairs", lambda pair: pair[value]).alias(name))


def attach_collections(claims: DataFrame, collections: Mapping[str, DataFrame], on: str) -> DataFrame:
    """Add an array column per collection; encounters without codes get an empty one."""
    for name, codes in collections.items():
        claims = claims.join(codes, on, "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast("array<string>"))
        )
    return claims


def dedup_or_conflict(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Equal rows with one id collapse; ids with differing rows are rejects.

    The smallest and the largest row of an id are equal exactly when all its
    rows are.  Both are map-side aggregates, so any number of copies of one id
    costs one row per task, and the surviving row needs no second join.
    """
    rest = [name for name in df.columns if name not in keys]
    row = F.struct(*rest)
    verdict = df.groupBy(*keys).agg(
        F.min(row).alias("_low"), F.max(row).alias("_high"), F.count(F.lit(1)).alias("copies")
    )
    agreed = F.col("_low").eqNullSafe(F.col("_high"))
    ok = verdict.filter(agreed).select(*keys, "_low.*").select(*df.columns)
    conflicts = verdict.filter(~agreed).select(*keys, "copies", F.array(F.lit("conflicting_rows")).alias("violations"))
    return ok, conflicts
