"""Column profiles, schema fingerprints, drift and bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.canonical import canonical_hash

TRUNCATED = "…[truncated]"
#: Longer values are compared by this many bytes of their digest; shorter ones by themselves.
_DIGEST_BYTES = 16


def primitive_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "string"
    return "unknown"


def variant_type(value: Column) -> Column:
    """Primitive type name of a variant value."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "BOOLEAN", "boolean")
        .when(name == "BIGINT", "integer")
        .when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(F.startswith(name, F.lit("ARRAY")), "array")
        .when(F.startswith(name, F.lit("OBJECT")), "object")
        .when(name == "VOID", F.lit(None))
        .otherwise("string")
    )


def _rendered(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(column)
    return column.cast("string")


def _type_of(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return variant_type(F.col(f"`{name}`"))
    return F.lit(primitive_type(kind))


def profile(df: DataFrame, artifact: str, columns: Sequence[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """One row per column: types seen, missing and distinct counts.

    Rows are unpivoted and first reduced to one row per column and distinct
    value, which bounds what follows by the distinct values and not by a hot one.
    ``max_rows`` limits the profile to a row-number prefix (``_row_number``), as
    a profile of a sample; the whole table is the default.
    """
    names = [name for name in (columns or df.columns) if name != "_row_number"]
    source = df.filter(F.col("_row_number") <= max_rows) if max_rows else df
    kinds = {field.name: field.dataType for field in df.schema.fields}
    # What is shuffled per value is narrow: the number of its column and the value, as it stands or as 128 bits of its
    # digest if it is longer.  Only the types of variants differ by row and go along.
    typed = ["type"] if any(isinstance(kinds[name], T.VariantType) for name in names) else []
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("at"),
                _rendered(name, kinds[name]).alias("value"),
                *[F.when(F.lit(isinstance(kinds[name], T.VariantType)), _type_of(name, kinds[name])).alias("type") for _ in typed],
            )
            for i, name in enumerate(names)
        ]
    )
    long = source.select(F.explode(cells).alias("c")).select("c.*")
    missing = F.col("value").isNull() | (F.col("value") == "")
    short = F.octet_length("value") < _DIGEST_BYTES
    key = F.when(short, F.col("value").cast("binary")).otherwise(F.unhex(F.left(F.sha2("value", 256), F.lit(2 * _DIGEST_BYTES))))
    keyed = long.select("at", F.when(~missing, key).alias("digest"), *[F.when(~missing, F.col(name)).alias(name) for name in typed])
    per_value = keyed.groupBy("at", "digest", *typed).agg(F.count(F.lit(1)).alias("n"))
    fixed = F.get(F.array(*[F.lit(None if isinstance(kinds[name], T.VariantType) else primitive_type(kinds[name])).cast("string") for name in names]), F.col("at"))
    seen = F.when(F.col("digest").isNotNull(), F.coalesce(fixed, *[F.col(name) for name in typed]))
    column_name = F.get(F.array(*[F.lit(name) for name in names]), F.col("at")).alias("column_name")
    per_column = per_value.groupBy("at").agg(
        F.array_sort(F.collect_set(seen)).alias("types"),
        F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("digest").alias("distinct_values"),
        F.sum("n").alias("rows"),
    )
    types = F.when(F.size("types") == 0, F.lit("null")).otherwise(F.concat_ws(",", "types"))
    return per_column.select(
        F.lit(artifact).alias("artifact"), column_name, types.alias("inferred_types"), "missing", "distinct_values", "rows"
    )


def approximate_profile(df: DataFrame, artifact: str, columns: Sequence[str]) -> DataFrame:
    """Missing and approximate distinct counts in one pass with fixed-size sketches."""
    measures = []
    for name in columns:
        value = F.nullif(F.col(f"`{name}`").cast("string"), F.lit(""))
        measures.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count_if(value.isNull()).alias("missing"),
                F.approx_count_distinct(value).alias("distinct_values"),
            )
        )
    return df.agg(F.array(*measures).alias("c")).select(F.lit(artifact).alias("artifact"), F.inline("c"))


def column_types(df: DataFrame, artifact: str) -> DataFrame:
    """Type per column in one pass: ``null`` when every value is missing."""
    cells = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        filled = column.isNotNull()
        if isinstance(field.dataType, T.StringType):
            filled = filled & (column != "")
        cells.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.when(F.bool_or(filled), F.lit(primitive_type(field.dataType)))
                .otherwise(F.lit("null"))
                .alias("inferred_types"),
            )
        )
    return df.agg(F.array(*cells).alias("c")).select(F.lit(artifact).alias("artifact"), F.inline("c"))


def schema_fingerprint(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digest over (artifact, column, types), independent of values and order.

    A profile has one row per column, bounded by the column limit of the ingest
    policy, so its sorted list is a small value.
    """
    column = F.struct("artifact", "column_name", "inferred_types")
    return profiles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("columns"),
        canonical_hash(columns=F.array_sort(F.collect_list(column))).alias("fingerprint"),
    )


def drifted(fingerprints: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings whose stored fingerprint differs from the one profiled now."""
    return mappings.join(
        fingerprints.select("artifact", F.col("fingerprint").alias("_now")), "artifact", "left"
    ).filter(~F.col("source_schema_fingerprint").eqNullSafe(F.col("_now")))


def bounded_samples(
    df: DataFrame,
    artifact: str,
    order: str,
    columns: Sequence[str],
    rows: int = 5,
    max_value: int = 512,
    max_total: int = 20_000,
) -> DataFrame:
    """Cells of the first ``rows`` rows, cut to ``max_value`` characters within a total budget.

    Sampling is the feature: the rows are a top-k by ``order``, after which the
    running character total covers ``rows * columns`` cells only.  Within a row
    the cells after the one that breaks the budget are left out; a later row
    may still fit.
    """
    leading = df.orderBy(order).limit(rows)
    value = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("value"),
            )
            for i, name in enumerate(columns)
        ]
    )
    cells = leading.select(F.col(order).alias("row_key"), F.posexplode(value).alias("_i", "cell")).select("row_key", "cell.*")
    cut = F.when(F.length("value") > max_value, F.concat(F.left("value", F.lit(max_value)), F.lit(TRUNCATED))).otherwise(
        F.col("value")
    )
    costed = cells.withColumn("sample", cut).withColumn("cost", F.length("column_name") + F.length("sample"))
    walk = costed.agg(
        F.array_sort(
            F.collect_list(F.struct("row_key", "position", "column_name", "value", "sample", "cost"))
        ).alias("cells")
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.lit(None).cast(df.schema[order].dataType).alias("broken_row"),
        F.array().cast("array<struct<row_key:bigint,column_name:string,sample:string,value_truncated:boolean>>").alias("kept"),
    )

    def step(state: Column, cell: Column) -> Column:
        over = (state["used"] + cell["cost"] > max_total) | state["broken_row"].eqNullSafe(cell["row_key"])
        full = state["used"] >= max_total
        kept = F.struct(
            cell["row_key"].cast("bigint").alias("row_key"),
            cell["column_name"].alias("column_name"),
            cell["sample"].alias("sample"),
            (F.length(cell["value"]) > max_value).alias("value_truncated"),
        )
        broken = F.struct(state["used"].alias("used"), cell["row_key"].alias("broken_row"), state["kept"].alias("kept"))
        grown = F.struct(
            (state["used"] + cell["cost"]).cast("bigint").alias("used"),
            state["broken_row"].alias("broken_row"),
            F.concat(state["kept"], F.array(kept)).alias("kept"),
        )
        return F.when(over | full, broken).otherwise(grown)

    return walk.select(F.inline(F.aggregate("cells", start, step)["kept"])).select(
        F.lit(artifact).alias("artifact"), "row_key", "column_name", "sample", "value_truncated"
    )
