"""Nested bundles with a manifest, and the review queue export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest_children(
    parents: DataFrame, children: DataFrame, on: str, name: str, order: Sequence[str], max_items: int
) -> tuple[DataFrame, DataFrame]:
    """Parents with their children as an array; parents beyond ``max_items`` are rejects.

    Children are counted before any is gathered, so no oversized list is built.
    """
    counts = children.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    over = counts.filter(F.col("_n") > max_items).select(on)
    fields = [field for field in children.columns if field != on]
    item = F.struct(*order, *[field for field in fields if field not in order])
    small = children.join(over, on, "left_anti")
    arrays = small.groupBy(on).agg(F.array_sort(F.collect_list(item)).alias(name))
    rejects = parents.join(over, on, "left_semi").withColumn("violations", F.array(F.lit(f"{name}_over_budget")))
    nested = parents.join(over, on, "left_anti").join(arrays, on, "left")
    kind = arrays.schema[name].dataType
    return nested.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind))), rejects


def bundle_file(position: Column, case_id: Column) -> Column:
    """File name of a bundle: its position and a short digest of the case id."""
    digits = position.cast("string")
    # Padded, never cut: positions from a million on keep all their digits.
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(padded, F.lit("-"), F.substring(F.sha2(case_id, 256), 1, 12), F.lit(".source-bundle.json"))


def rank_by_id(df: DataFrame, order: str, width: int) -> DataFrame:
    """Dense position of every row by a unique integer id, without a one-task sort.

    Ids are cut into ranges of ``width``; a window numbers each range and the
    counts of the ranges before it are added.
    """
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_range").orderBy(order)
    return (
        cut.withColumn("_position", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn("position", (F.col("_position") + F.col("_offset")).cast("bigint"))
        .drop("_range", "_position", "_offset")
    )


def write_bundles(bundles: DataFrame, path: str, partitions: str | None = None) -> None:
    """One JSON document per line and case, partitioned for later pruning."""
    writer = bundles.write.mode("overwrite")
    (writer.partitionBy(partitions) if partitions else writer).json(path)


def manifest(cases: DataFrame, order: str, width: int) -> DataFrame:
    """``(case_id, encounter_id, file)`` in order of the encounter id."""
    ranked = rank_by_id(cases, order, width)
    return ranked.select(
        "position", "case_id", "encounter_id", bundle_file(F.col("position"), F.col("case_id")).alias("file")
    )


def export_queue(queue: DataFrame, path: str) -> None:
    """Quoted delimited export with a header."""
    queue.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
