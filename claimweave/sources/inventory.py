"""Inventory of an input folder, its limits and its content manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash, multiset_fingerprint
from claimweave.operators.scale import reasons, split_rejects

# File extensions that are read, and their formats.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "xlsx": "xlsx"}


@dataclass(frozen=True)
class IngestPolicy:
    max_files: int = 5_000
    max_file_bytes: int = 1_000_000_000
    max_total_bytes: int = 20_000_000_000


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def inventory(spark: SparkSession, root: str, policy: IngestPolicy = IngestPolicy()) -> tuple[DataFrame, DataFrame]:
    """``(artifacts, rejects)``: every file with its relative path, format and size.

    The content column is never read here.  Unsupported files stay in the inventory.
    """
    base = root.rstrip("/") + "/"
    listed = _files(spark, root).select(
        F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size_bytes")
    )
    extension = F.lower(F.substring_index("path", ".", -1))
    known = F.create_map(*[F.lit(part) for pair in FORMATS.items() for part in pair])
    shaped = listed.withColumn("format", F.coalesce(F.try_element_at(known, extension), F.lit("unsupported")))
    return split_rejects(shaped, reasons(file_too_large=F.col("size_bytes") > policy.max_file_bytes))


def inventory_totals(artifacts: DataFrame, policy: IngestPolicy = IngestPolicy()) -> DataFrame:
    """One row with the number and size of files and the limits they break."""
    totals = artifacts.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    )
    return totals.withColumn(
        "violations",
        reasons(
            too_many_files=F.col("files") > policy.max_files,
            too_many_bytes=F.col("total_bytes") > policy.max_total_bytes,
        ),
    )


def content_digests(spark: SparkSession, root: str, policy: IngestPolicy = IngestPolicy()) -> DataFrame:
    """``(path, size_bytes, sha256)``; files beyond the size limit are filtered before they are read."""
    base = root.rstrip("/") + "/"
    return (
        _files(spark, root)
        .filter(F.col("length") <= policy.max_file_bytes)
        .select(
            F.substring_index("path", base, -1).alias("path"),
            F.col("length").alias("size_bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
    )


def manifest_digest(digests: DataFrame) -> DataFrame:
    """Order-insensitive digest of all files, unsupported ones included."""
    entry = canonical_hash(path=F.col("path"), size_bytes=F.col("size_bytes"), sha256=F.col("sha256"))
    return digests.select(entry.alias("_digest")).agg(
        F.count(F.lit(1)).alias("files"), multiset_fingerprint(F.col("_digest")).alias("manifest_digest")
    )
