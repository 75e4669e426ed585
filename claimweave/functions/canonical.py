"""Canonical JSON, digests and identifiers, computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(**fields: Column) -> Column:
    """JSON text with keys in order, compact and with explicit nulls."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), _KEEP_NULLS)


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def short_id(prefix: str, digest: Column, width: int) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest, 1, width))


def sorted_map(value: Column) -> Column:
    """A map with its entries in key order, so that equal maps print alike."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """Digest of one row over ``columns``; timestamps are rendered in UTC-free ISO text."""
    fields = {}
    for name in columns:
        column = F.col(name)
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        fields[name] = column
    return canonical_hash(**fields)


def multiset_fingerprint(digest: Column) -> Column:
    """Order-insensitive digest of a whole set of rows, as one aggregate.

    Every row digest is cut into eight 32-bit words whose sums are hashed
    together with the row count.  Sums combine map-side, so a table of any size
    (and any skew) costs one fixed-width buffer per task, where hashing a sorted
    list would gather the table in one row.  Duplicated rows count.
    """
    words = [_word_sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words), 256)


def _word_sum(word: Column) -> Column:
    """Exact sum of 32-bit words: the halves are summed as integers, which hold for 2^47 rows and need no decimals per row."""
    high, low = F.sum(F.shiftright(word, 16)), F.sum(word.bitwiseAND(F.lit(0xFFFF)))
    return high.cast("decimal(28,0)") * F.lit(1 << 16).cast("decimal(6,0)") + low.cast("decimal(20,0)")


def dataset_fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Fingerprint of a table, or of every group of it."""
    digested = df.select(*(by or []), row_digest(df, columns).alias("_digest"))
    aggregate = [
        F.count(F.lit(1)).alias("row_count"),
        multiset_fingerprint(F.col("_digest")).alias("fingerprint"),
    ]
    return digested.groupBy(*by).agg(*aggregate) if by else digested.agg(*aggregate)
