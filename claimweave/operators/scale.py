"""Building blocks that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one ordered chain that a single window task may hold.
SEGMENT_ROWS = 1 << 20
#: Salts over which a group is spread before its leading rows are chosen.
SALTS = 32


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_by: str
) -> DataFrame:
    """The first ``k`` rows of every group, with their position in ``_rank``.

    Each group is first spread over salts by ``spread_by``; a salt keeps its own
    first ``k`` rows, so the final task of a group sees at most ``k * SALTS``
    rows.  Both rank filters also run before their shuffle (window group limit).
    ``order`` must end in a unique key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    leading = salted.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= k).drop("_rank", "_salt")
    overall = Window.partitionBy(*keys).orderBy(*order)
    return leading.withColumn("_rank", F.row_number().over(overall)).filter(F.col("_rank") <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread_by: str) -> DataFrame:
    return top_k_per_group(df, keys, order, 1, spread_by).drop("_rank")


def count_per_key(df: DataFrame, keys: Sequence[str], name: str = "_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def previous_in_chain(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    value: str,
    name: str = "_previous",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``lag(value)`` along ``sequence`` within ``keys`` without one task per chain.

    A chain is cut into segments of consecutive sequence numbers.  The lag runs
    inside every segment and the first row of a segment takes the last value of
    the segment before it, found among one row per segment.  ``sequence`` must be
    a unique integer, which bounds a segment by ``segment_rows`` rows.
    """
    segment = F.floor(F.col(sequence) / F.lit(segment_rows)).cast("bigint")
    cut = df.withColumn("_segment", segment)
    inside = Window.partitionBy(*keys, "_segment").orderBy(sequence)
    lagged = cut.withColumn("_lag", F.lag(value).over(inside)).withColumn("_position", F.row_number().over(inside))
    tails = cut.groupBy(*keys, "_segment").agg(F.max_by(value, sequence).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_segment")
    heads = tails.withColumn("_before", F.lag("_tail").over(across)).drop("_tail")
    joined = lagged.join(heads, [*keys, "_segment"], "left")
    return joined.withColumn(
        name, F.when(F.col("_position") == 1, F.col("_before")).otherwise(F.col("_lag"))
    ).drop("_segment", "_lag", "_position", "_before")


def split_rejects(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """``(ok, rejects)``; rejects keep every reason that applies to the row."""
    return split_checked(df.withColumn("violations", violations))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ok, rejects)`` of rows that carry their ``violations``."""
    ok = checked.filter(F.size("violations") == 0).drop("violations")
    return ok, checked.filter(F.size("violations") > 0)


def reasons(**checks: Column) -> Column:
    """Array of the names whose check column is true, in the order given."""
    found = [F.when(F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()]
    return F.array_compact(F.array(*found))


def first_reason(**checks: Column) -> Column:
    """Name of the first check that is true, else null (an ordered cascade)."""
    return F.coalesce(*[F.when(F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()])
