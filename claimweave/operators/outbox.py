"""Routing outbox: idempotent enqueue, delivery log and pending tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash, short_id
from claimweave.operators.scale import first_per_group, reasons, split_rejects

KEY = ["tenant_id", "workspace_id", "automation_id"]


def route_tasks(items: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Tasks for automatically routed items; ungoverned queue or action is a reject."""
    routed = items.filter(F.col("tier") == "auto_routed")
    ok, rejects = split_rejects(
        routed,
        reasons(
            no_queue=F.col("queue").isNull() | (F.col("queue") == "none"),
            no_route=~F.coalesce(F.startswith("recommended_action", F.lit("route_to_")), F.lit(False)),
        ),
    )
    digest = canonical_hash(
        action=F.col("recommended_action"),
        automation_id=F.col("automation_id"),
        finding_id=F.col("finding_id"),
        packet_id=F.col("packet_id"),
        queue=F.col("queue"),
        tenant_id=F.col("tenant_id"),
        workspace_id=F.col("workspace_id"),
    )
    tasks = ok.select(
        short_id("route", digest, 20).alias("route_id"),
        *KEY,
        "packet_id",
        "finding_id",
        "queue",
        F.col("recommended_action").alias("action"),
        F.lit(as_of).alias("created_at"),
    )
    return tasks, rejects


def new_tasks(tasks: DataFrame, outbox: DataFrame) -> DataFrame:
    """Tasks whose key is not stored yet, one per key; the first stored one is kept."""
    once = first_per_group(tasks, KEY, [F.asc("created_at"), F.asc("route_id")], "route_id")
    return once.join(outbox.select(*KEY), KEY, "left_anti")


def mark_delivered(deliveries: DataFrame, outbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery rows of known tasks in tenant scope; unknown or repeated ones are rejects."""
    key = ["tenant_id", "workspace_id", "route_id"]
    known = outbox.select(*key, F.lit(True).alias("_known"))
    first = deliveries.groupBy(*key).agg(F.min("sequence").alias("_first"))
    joined = deliveries.join(first, key).join(known, key, "left")
    ok, rejects = split_rejects(
        joined,
        reasons(unknown_task=F.col("_known").isNull(), already_delivered=F.col("sequence") != F.col("_first")),
    )
    return ok.drop("_known", "_first"), rejects.drop("_known", "_first")


def pending(outbox: DataFrame, delivered: DataFrame) -> DataFrame:
    key = ["tenant_id", "workspace_id", "route_id"]
    return outbox.join(delivered.select(*key), key, "left_anti")
